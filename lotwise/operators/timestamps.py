"""Mixed timestamp formats and zones, normalised to one instant.

1. Every value becomes an array of all its valid readings (Arrow batches, each distinct value once):
   every order of day and month that fits, each with a cost that says how unlikely it is.
2. Wall clocks become instants natively, with the zone stated, else with the zone of the row and, at
   a cost, with UTC. A wall clock that a change of offset doubles has two instants, one that it skips
   has none.
3. Readings are chosen by Viterbi over each source's record order: a change of format and a backward
   jump in time cost, beside the readings' own costs. The order is cut into blocks of ``block`` places;
   each is summed up by the costs between the candidates of its first and last record, these are joined
   level by level, and the ends found are handed down again. So the result is that of one chain over
   the whole source, and no task holds more than a block or ``FAN`` tables.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import instants
from lotwise.functions.chains import NONE, Chain, Costs, Stretch, combine, resolve

#: Tables that are joined at once.
FAN = 1000
_READING = T.StructType(
    [
        T.StructField("format", T.IntegerType()),
        T.StructField("wall", T.LongType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("zone", T.StringType()),
        T.StructField("cost", T.DoubleType()),
    ]
)
_STRETCH = "src string, block bigint, cost binary, first_f binary, first_t binary, last_f binary, last_t binary"


def format_id(name: str) -> int:
    return zlib.crc32(name.encode()) & 0x7FFFFFFF


def readings(date: Column, time: Column | None = None, day_first: bool | None = None, unlikely: dict[str, float] | None = None) -> Column:
    """array<struct<format, wall, offset, zone, cost>> of all valid readings; empty for null and junk.

    ``unlikely``: costs by what a format's name begins with, such as mdy for the month first.
    ``day_first`` other than None generates that order of numeric dates only.
    """
    costs = unlikely or {}

    @F.pandas_udf(T.ArrayType(_READING))
    def parse(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values)
        found = []
        for u in uniques:
            d, _, t = u.partition("\x1f")
            rows = instants.readings(d, t, day_first)
            found.append([(format_id(r[0]), *r[1:], max((c for k, c in costs.items() if r[0].startswith(k)), default=0.0)) for r in rows])
        found.append([])
        named = [[dict(zip(_READING.names, r, strict=True)) for r in rows] for rows in found]
        return pd.Series([named[c] for c in codes], dtype=object)

    run = parse.asNondeterministic()  # else filters on its result would be pushed below it, and it would run twice
    return run(F.concat(F.coalesce(date, F.lit("")), F.lit("\x1f"), F.coalesce(time, F.lit("")) if time is not None else F.lit("")))


def as_instants(found: Column, zone: Column, universal: float | None = None) -> Column:
    """array<struct<format, at, cost>>: the instants that readings may mean, in seconds since the epoch.

    A reading without a stated zone is of ``zone``, and at the cost ``universal`` (None: never) of UTC.
    Both instants of a doubled hour are given, the earlier first, and none of a skipped one. A reading
    without any zone has no instant.
    """
    shown = lambda at, named: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), named))

    def one(r: Column) -> Column:
        named = F.coalesce(r["zone"], zone)
        wall = r["wall"]
        local = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), named))
        stated = r["offset"].isNotNull()
        entry = lambda at, cost: F.struct(r["format"].alias("format"), at.cast("bigint").alias("at"), cost.cast("double").alias("cost"))
        both = F.transform(
            F.array(F.when(~stated & named.isNotNull(), local)),
            lambda at: F.array(
                entry(F.when(stated, wall - r["offset"]).when(shown(at, named) == wall, at), r["cost"]),
                entry(F.when(~stated & (shown(at + 3600, named) == wall), at + 3600), r["cost"]),
            ),
        )
        plain = F.when(~stated & r["zone"].isNull(), wall) if universal is not None else F.lit(None).cast("bigint")
        return F.concat(F.get(both, F.lit(0)), F.array(entry(plain, r["cost"] + F.lit(universal or 0.0))))

    return F.filter(F.flatten(F.transform(found, one)), lambda x: x["at"].isNotNull())


def _packed(s: Stretch) -> dict[str, bytes]:
    return {"cost": s.table.tobytes(), "first_f": s.first[0].tobytes(), "first_t": s.first[1].tobytes(), "last_f": s.last[0].tobytes(), "last_t": s.last[1].tobytes()}


def _stretches(g: pd.DataFrame) -> list[Stretch]:
    out = []
    for r in g.sort_values("block").itertuples(index=False):
        first = (np.frombuffer(r.first_f, np.int64), np.frombuffer(r.first_t, np.int64))
        last = (np.frombuffer(r.last_f, np.int64), np.frombuffer(r.last_t, np.int64))
        out.append(Stretch(np.frombuffer(r.cost, np.float64).reshape(len(first[0]), len(last[0])), first, last))
    return out


def _chain(g: pd.DataFrame, costs: Costs, none: float | None) -> tuple[pd.DataFrame, Chain]:
    """The records in order, and their chain; the last candidate of each says nothing if ``none`` is a cost."""
    g = g.assign(least=[t.min() for t in g["t"]]).sort_values(["pos", "least"], kind="stable")
    sizes = np.array([len(t) for t in g["t"]])
    k = int(sizes.max()) + (none is not None)
    inside = np.arange(k) < sizes[:, None]
    cost, form, time = np.full(inside.shape, np.inf), np.full(inside.shape, NONE, np.int64), np.zeros(inside.shape, np.int64)
    cost[inside], form[inside], time[inside] = np.concatenate(g["p"].to_list()), np.concatenate(g["f"].to_list()), np.concatenate(g["t"].to_list())
    if none is not None:
        cost[np.arange(len(g)), sizes] = none
    return g, Chain(cost, form, time, costs)


def choose(
    df: DataFrame, source: str, order: str, candidates: str, switch: float = 1.0, backward: float = 0.5, none: float | None = None, block: int = 20_000, span: int | None = None
) -> DataFrame:
    """(source, order, at): the chosen instant of each record of ``df`` that has a reading.

    ``candidates``: array of structs of format, at and, if readings differ in likelihood, cost.
    ``order`` is the record's place in its source, a whole number. At the cost ``none`` (if given) a
    record may be left without an instant; it gives no row then. Records without a reading or
    a place are left out of the chain and of the result; those without a source are one source. ``span``: how far apart the first and the last place are at most;
    counted from ``df`` if it is not known. Ties in ``order`` are put in order of their least instants, of
    chains that cost the same the one of earlier listed readings is taken. An empty table gives an
    empty table.
    """
    fields = df.schema[candidates].dataType.elementType.fieldNames()
    c = F.col(candidates)
    form = F.col(f"{candidates}.format") if dict(df.select(F.get(c, F.lit(0))["format"].alias("f")).dtypes)["f"] == "int" else F.transform(c, lambda x: F.hash(x["format"]).bitwiseAND(F.lit(0x7FFFFFFF)))
    price = F.col(f"{candidates}.cost") if "cost" in fields else F.transform(c, lambda _: F.lit(0.0))
    rows = df.filter((F.size(c) > 0) & F.col(order).isNotNull()).select(
        F.col(source).alias("src"), F.col(order).cast("bigint").alias("pos"), F.floor(F.col(order).cast("bigint") / block).alias("block"),
        form.alias("f"), F.col(f"{candidates}.at").alias("t"), price.alias("p"),
    )
    costs = Costs(switch, backward)

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        _, chain = _chain(g, costs, none)
        return pd.DataFrame([{"src": g["src"].iloc[0], "block": g["block"].iloc[0], **_packed(combine(chain.stretches(), costs))}])

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"src": g["src"].iloc[0], "block": g["up"].iloc[0], **_packed(combine(_stretches(g), costs))}])

    def settled(g: pd.DataFrame) -> pd.DataFrame:
        ends = resolve(_stretches(g), costs)
        g = g.sort_values("block")
        return pd.DataFrame({"src": g["src"], "block": g["block"], "a": [a for a, _ in ends], "b": [b for _, b in ends]})

    def handed_down(g: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        ends = resolve(_stretches(g), costs, int(end["a"].iloc[0]), int(end["b"].iloc[0]))
        g = g.sort_values("block")
        return pd.DataFrame({"src": g["src"], "block": g["block"], "a": [a for a, _ in ends], "b": [b for _, b in ends]})

    def picked(g: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        g, chain = _chain(g, costs, none)
        at = chain.pick(resolve(chain.stretches(), costs, int(end["a"].iloc[0]), int(end["b"].iloc[0])))
        sizes = np.array([len(t) for t in g["t"]])
        said = at < sizes
        instant = np.concatenate(g["t"].to_list())[(np.cumsum(sizes) - sizes + np.minimum(at, sizes - 1))]
        return pd.DataFrame({"src": g["src"].to_numpy()[said], "pos": g["pos"].to_numpy()[said], "at": instant[said]})

    level = rows.groupBy("src", "block").applyInPandas(summed, _STRETCH)
    blocks = (rows.agg((F.max("block") - F.min("block")).alias("span")).first()["span"] or 0) if span is None else span // block + 1
    levels = [level]
    while blocks >= FAN:
        level = level.withColumn("up", F.floor(F.col("block") / FAN)).groupBy("src", "up").applyInPandas(joined, _STRETCH)
        levels.append(level)
        blocks = blocks // FAN + 1
    schema = "src string, block bigint, a int, b int"
    ends = levels[-1].groupBy("src").applyInPandas(settled, schema)
    for below in reversed(levels[:-1]):
        up = below.withColumn("up", F.floor(F.col("block") / FAN))
        ends = up.groupBy("src", "up").cogroup(ends.withColumnRenamed("block", "up").groupBy("src", "up")).applyInPandas(handed_down, schema)
    return rows.groupBy("src", "block").cogroup(ends.groupBy("src", "block")).applyInPandas(picked, "src string, pos bigint, at bigint")
