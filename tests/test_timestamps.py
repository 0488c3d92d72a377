import calendar
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import chains
from lotwise.functions.instants import readings
from lotwise.operators import timestamps


def utc(text):
    y, m, d, h, mi, s = map(int, text.replace("T", "-").replace(":", "-").split("-"))
    return calendar.timegm((y, m, d, h, mi, s))


@pytest.mark.parametrize(
    ("date", "time", "wall", "offset", "zone"),
    [
        ("2025-03-01T10:00:00+01:00", "", "2025-03-01T10:00:00", 3600, None),
        ("03/04/2025 24:00", "", "2025-04-04T00:00:00", None, None),
        ("12-11-24", "5:00 PM", "2024-11-12T17:00:00", None, None),
        ("Nov 15, 2026 12:30 AM", "", "2026-11-15T00:30:00", None, None),
        ("14-OTT-25 10:00:00", "", "2025-10-14T10:00:00", None, None),
        ("2025-01-23+01:00", "10:00", "2025-01-23T10:00:00", 3600, None),
        ("2025-01-23", "10:00:00 (Europe/Rome)", "2025-01-23T10:00:00", None, "Europe/Rome"),
        ("15 janvier 2026 à 23h59", "", "2026-01-15T23:59:00", None, None),
        ("20250301", "1130", "2025-03-01T11:30:00", None, None),
        ("1757929500000", "", "2025-09-15T09:45:00", 0, None),
        ("2025-08-11 23:59:59, 2025-08-11 23:59:59", "", "2025-08-11T23:59:59", None, None),
        ("2025-03-01 10:00 GMT+2", "", "2025-03-01T10:00:00", 7200, None),
    ],
)
def test_readings(date, time, wall, offset, zone):
    assert [r[1:] for r in readings(date, time)] == [(utc(wall), offset, zone)]


@pytest.mark.parametrize("text", ["", "n.d.", "2025-01-23", "10:00", "31/02/2026 12:00", "2026-13-45T10:00:00Z", "2025-01-23+01:00", "10:00 (Europe/Nowhere)", "99999999999999999999"])
def test_no_instant(text):
    assert readings(text) == []


def test_all_orders():
    assert {r[0] for r in readings("03/04/2025 10:00", day_first=None)} == {"dmy/ hms", "mdy/ hms"}


def _costs(paths, form, time, cost, costs):
    out = []
    for p in paths:
        total = sum(c[k] for c, k in zip(cost, p, strict=True))
        for i in range(1, len(p)):
            f0, f1 = form[i - 1][p[i - 1]], form[i][p[i]]
            if chains.NONE not in (f0, f1):
                total += costs.switch * (f0 != f1) + costs.backward * (time[i][p[i]] < time[i - 1][p[i - 1]])
        out.append(total)
    return out


def test_a_chain_is_the_cheapest_however_it_is_cut():
    rng = np.random.default_rng(3)
    costs = chains.Costs(1.0, 0.5)
    for _ in range(30):
        n, k = 7, 3
        form, time = rng.integers(-1, 2, (n, k)), rng.integers(0, 50, (n, k))
        cost = np.where(rng.random((n, k)) < 0.3, np.inf, rng.integers(0, 3, (n, k)) / 2)
        cost[:, 0] = np.minimum(cost[:, 0], 5)
        best = min(_costs(product(range(k), repeat=n), form, time, cost, costs))
        for cut in (n, 3, 1):
            parts = [chains.Chain(cost[i : i + cut], form[i : i + cut], time[i : i + cut], costs) for i in range(0, n, cut)]
            ends = chains.resolve([chains.combine(c.stretches(), costs) for c in parts], costs)
            path = [int(x) for c, (a, b) in zip(parts, ends, strict=True) for x in c.pick(chains.resolve(c.stretches(), costs, a, b))]
            assert _costs([path], form, time, cost, costs) == [best]


def _chosen(spark, rows, **options):
    df = spark.createDataFrame(rows, "src string, pos long, d string")
    c = df.select("src", "pos", timestamps.as_instants(timestamps.readings(F.col("d")), F.lit("UTC")).alias("c"))
    return {(r.src, r.pos): r["at"] for r in timestamps.choose(c, "src", "pos", "c", **options).collect()}


def test_choose_across_blocks_and_levels(spark, monkeypatch):
    rows = [("s", i, f"{i % 12 + 1:02d}/13/2025 10:00" if i % 5 == 0 else f"{i % 12 + 1:02d}/05/2025 10:00") for i in range(60)]
    rows += [("t", 1, None), ("t", 2, "junk"), ("u", -7, "03/04/2025 10:00")]
    whole = _chosen(spark, rows, block=1000)
    assert _chosen(spark, rows, block=16) == whole and len(whole) == 61
    monkeypatch.setattr(timestamps, "FAN", 3)  # three levels of tables
    assert _chosen(spark, rows, block=4) == whole
    assert _chosen(spark, [("s", 1, None)]) == {}
    assert _chosen(spark, [(None, 1, "03/04/2025 10:00"), (None, 2, "2025-01-01 10:00"), ("s", None, "2025-01-01 10:00")], block=1).keys() == {(None, 1), (None, 2)}


def test_only_the_chain_decides(spark):
    # each date may be read both ways; one record far away has the month first for certain
    rows = [("s", i, f"{i + 1:02d}/{i + 2:02d}/2025 10:00") for i in range(9)] + [("s", 40, "10/31/2025 10:00")]
    got = _chosen(spark, rows, block=4)
    assert [got["s", i] for i in range(9)] == [utc(f"2025-{i + 1:02d}-{i + 2:02d}T10:00:00") for i in range(9)]
    other = _chosen(spark, [*rows[:9], ("s", 40, "31/10/2025 10:00")], block=4)
    assert [other["s", i] for i in range(9)] == [utc(f"2025-{i + 2:02d}-{i + 1:02d}T10:00:00") for i in range(9)]


def test_rules_outweigh_neighbours(spark):
    df = spark.createDataFrame([("s", 0, "10/31/2025 10:00"), ("s", 1, "03/04/2025 10:00"), ("s", 2, "10/30/2025 10:00")], "src string, pos long, d string")
    found = timestamps.readings(F.col("d"), unlikely={"mdy": 12.0})
    c = df.select("src", "pos", timestamps.as_instants(found, F.lit("Europe/Rome"), 12.0).alias("c"))
    assert max(len(r.c) for r in c.collect()) == 4  # two orders, two zones
    got = {r.pos: r["at"] for r in timestamps.choose(c, "src", "pos", "c", none=6.0).collect()}
    assert got == {1: utc("2025-04-03T08:00:00")}  # the others have no reading within the rules


def test_local_zone(spark):
    rows = [("2025-07-01 12:00:00", "Europe/Rome"), ("2025-01-01 12:00:00", "Europe/Rome"), ("2025-01-01 12:00:00", None), ("2025-10-26 02:30:00", "Europe/Rome"), ("2025-03-30 02:30:00", "Europe/Rome")]
    df = spark.createDataFrame(rows, "d string, z string")
    got = [[x["at"] for x in r[0]] for r in df.select(timestamps.as_instants(timestamps.readings(F.col("d")), F.col("z"))).collect()]
    assert got == [[utc("2025-07-01T10:00:00")], [utc("2025-01-01T11:00:00")], [], [utc("2025-10-26T00:30:00"), utc("2025-10-26T01:30:00")], []]
