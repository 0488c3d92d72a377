"""Mixing sources to target shares under a time-varying curriculum.

Each source has a weight schedule over training time from 0 to 1, piecewise linear with the target
share as its integral. A document's place in its source's cumulative tokens is a demand that the
inverse of the integrated schedule turns into a training position; positions are then range-sorted.
Cumulative tokens come from two levels of sums, so no source is ever in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A schedule: its times from 0 to 1, and its weight at each of them.
Schedule = tuple[list[float], list[float]]


def fading(shares: dict[str, float], order: list[str], steepest: float = 0.8) -> dict[str, Schedule]:
    """Straight schedules in which the sources first in ``order`` fade out and the last fade in.

    The total rate is constant. Sources that ``order`` lacks keep their share throughout.
    """
    known = [s for s in order if s in shares]
    raw = {s: (2 * i / (len(known) - 1) - 1 if len(known) > 1 else 0.0) for i, s in enumerate(known)}
    whole = sum(shares[s] for s in known)
    mean = sum(shares[s] * raw[s] for s in known) / whole if whole else 0.0
    most = max((abs(v - mean) for v in raw.values()), default=0.0) or 1.0
    slopes = {s: steepest * (raw[s] - mean) / most if s in raw else 0.0 for s in shares}
    return {s: ([0.0, 1.0], [1.0 - a, 1.0 + a]) for s, a in slopes.items()}


def checked(schedule: Schedule) -> Schedule:
    """The schedule, if its times rise from 0 to 1 and its weights are no less than 0 and not all 0."""
    knots, weights = schedule
    if len(knots) != len(weights) or len(knots) < 2 or knots[0] != 0 or knots[-1] != 1 or any(a >= b for a, b in zip(knots, knots[1:], strict=False)) or min(weights) < 0 or max(weights) <= 0:
        raise ValueError(f"no schedule: {schedule}")
    return [float(k) for k in knots], [float(w) for w in weights]


def invert(done: Column, knots: Column, weights: Column) -> Column:
    """The time at which a schedule has given the share ``done`` of its whole.

    ``knots``: times from 0 to 1, ``weights``: the schedule there (not all zero), linear between.
    """
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda k: F.struct(
            F.get(knots, k - 1).alias("t"),
            (F.get(knots, k) - F.get(knots, k - 1)).alias("dt"),
            F.get(weights, k - 1).alias("w"),
            (F.get(weights, k) - F.get(weights, k - 1)).alias("dw"),
        ),
    )
    area = lambda p: p["dt"] * (p["w"] + p["dw"] / 2)
    whole = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + area(p))

    def step(state: Column, p: Column) -> Column:
        rest, found = state["rest"], state["at"]
        a, b = p["dw"] / 2, p["w"]
        x = F.try_divide(F.greatest(rest, F.lit(0.0)), p["dt"])  # of the piece, with time from 0 to 1
        root = F.when(F.abs(a) < 1e-12, F.try_divide(x, b)).otherwise(F.try_divide(2 * x, b + F.sqrt(F.greatest(b * b + 4 * a * x, F.lit(0.0)))))
        here = p["t"] + p["dt"] * F.least(F.coalesce(root, F.lit(0.0)), F.lit(1.0))
        inside = found.isNull() & (rest <= area(p))
        return F.struct((rest - area(p)).alias("rest"), F.when(inside, here).otherwise(found).alias("at"))

    start = F.struct((done * whole).cast("double").alias("rest"), F.lit(None).cast("double").alias("at"))
    return F.coalesce(F.aggregate(pieces, start, step)["at"], F.lit(1.0))


def cumulative(documents: DataFrame, key: str, source: str, size: str, per_bucket: int = 20_000, seed: int = 11) -> DataFrame:
    """(key, source, size, before): the source's sizes before each row, in order of a hash.

    The hash's first bits make buckets of about ``per_bucket`` rows; their sums are accumulated over
    buckets, the rows' within their bucket. Ties of the hash are put in order of key and size.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / per_bucket)))
    h = F.xxhash64("key", F.lit(seed))
    rows = rows.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("of"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("of").over(earlier), F.lit(0))).drop("of")
    own = Window.partitionBy("source", "bucket").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return within.join(offsets, ["source", "bucket"]).select("key", "source", "size", (F.col("offset") + F.col("inside")).alias("before"))


def plan(supplies: dict[str, int], targets: list[tuple], schedules: dict[str, Schedule] | None, order: list[str], most: int) -> list[tuple]:
    """(mix, source, share, repeats, supply, demand, knots, weights) of each mix and source.

    ``targets``: (mix, source, share, repeats). A mix is as large as its scarcest source allows
    within its repeats, and at most ``most``. Sources without a supply are left out, the others'
    shares scaled to add up to 1. Without ``schedules`` they fade in by ``order``; with them, a
    source they lack keeps its share throughout.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        rows = [(s, share, r) for m, s, share, r in targets if m == mix and supplies.get(s, 0) > 0 and share > 0 and r > 0]
        whole = sum(share for _, share, _ in rows)
        if not rows:
            continue
        total = min(most, min(r * supplies[s] * whole / share for s, share, r in rows))
        given = fading({s: share / whole for s, share, _ in rows}, order) if schedules is None else schedules
        for s, share, r in rows:
            knots, weights = checked(given.get(s, ([0.0, 1.0], [1.0, 1.0])))
            out.append((mix, s, share / whole, int(r), int(supplies[s]), share / whole * total, knots, weights))
    return out


def mix(documents: DataFrame, key: str, source: str, size: str, targets: DataFrame, schedules: dict[str, Schedule] | None = None, most: int | None = None) -> DataFrame:
    """(mix_id, position, key, source, copy, tokens), sorted by mix and position.

    ``schedules``: by source, times from 0 to 1 and the weight at each, linear between them; only
    their shape counts, as the source's share is that of ``targets``. Without any, sources of short
    documents fade out and those of long ones fade in. A mix has at most ``most`` tokens (all there
    are if it is None: a document is repeated to meet the shares, not to make the mix larger).

    ``documents`` is read twice, so pass sizes that are stored rather than recomputed. Documents of
    null or unnamed sources and of no size are not taken. A copy is taken if its middle lies within
    its source's demand, so a source misses its share by less than one document. ``targets``
    (mix_id, source, target_share, max_repeats) is a small reference table.
    """
    some = documents.filter((F.col(size) >= 1) & F.col(source).isNotNull())
    named = F.broadcast(targets.select(F.col("source").alias(source)).distinct())
    sums = some.groupBy(source).agg(F.sum(size).alias("of"), F.avg(size).alias("mean")).join(named, source).collect()  # a row a named source
    supplies = {r[0]: r["of"] for r in sums}
    order = [r[0] for r in sorted(sums, key=lambda r: (r["mean"], r[0]))]
    wanted = [tuple(r) for r in targets.select("mix_id", "source", "target_share", "max_repeats").collect()]
    rows = plan(supplies, wanted, schedules, order, sum(supplies.values()) if most is None else most)
    spark = documents.sparkSession
    plans = spark.createDataFrame(rows, "mix_id int, source string, share double, repeats int, supply bigint, demand double, knots array<double>, weights array<double>")
    placed = cumulative(some, key, source, size).join(F.broadcast(plans), "source")
    middle = F.col("before") + F.col("size") / 2
    copies = F.least(F.col("repeats").cast("bigint"), F.floor((F.col("demand") - middle) / F.col("supply")) + 1)
    taken = placed.withColumn("copies", copies).filter("copies >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    done = ((F.col("copy") - 1) * F.col("supply") + middle) / F.col("demand")
    return (
        taken.select("mix_id", invert(done, F.col("knots"), F.col("weights")).alias("position"), "key", "source", "copy", F.col("size").alias("tokens"))
        .withColumnRenamed("key", key)
        .orderBy("mix_id", "position", key, "copy")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """By mix and source: documents taken, tokens, the actual share and the target."""
    by = mixed.groupBy("mix_id", "source").agg(F.count("*").alias("taken"), F.max("copy").alias("most_copies"), F.sum("tokens").alias("tokens"))
    total = by.groupBy("mix_id").agg(F.sum("tokens").alias("of"))
    return (
        targets.join(by, ["mix_id", "source"], "left")
        .join(total, "mix_id", "left")
        .select(
            "mix_id",
            "source",
            "target_share",
            F.coalesce(F.col("tokens") / F.col("of"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("taken", F.lit(0)).alias("taken"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
        )
    )
