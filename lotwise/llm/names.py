"""Variant spellings of typed names, linked to the entity of a register that they mean.

All work is on distinct writings, stored once. What people write for the kinds of bodies is learned
from them (:mod:`variants`), and names are rewritten to canonical tokens. Distinct tokens are then
joined to the register's tokens by the rarest q-grams of each (prefix filter), names to entries by the
rarest tokens of each entry (prefix filter again), and the pairs verified by soft token similarity
weighted by rarity. A name that makes up a large part of all rows is linked by a broadcast, the
others by a shuffle, so no task holds one name's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm import naming, variants

_WORDS = T.ArrayType(T.StringType())
#: Names that make up more than this share of the rows (of which there are at most as many as it goes into 1) are broadcast.
_HOT = 1 / 1000


def canonical(name: Column, canon: naming.Canon | None = None) -> Column:
    """The canonical tokens of a name as one string; empty for empty names, null for null."""
    canon = canon or naming.Canon()

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values)
        found = [" ".join(canon.tokens(u)) for u in uniques] + [None]
        return pd.Series([found[c] for c in codes], dtype=object)

    return run(name)


def grams(word: Column) -> Column:
    """The distinct pairs of neighbouring signs of a word, with its ends marked."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(2))))


def _prefixes(df: DataFrame, word: str, order: DataFrame) -> DataFrame:
    """(word, gram): the rarest grams of each word, so many that any word within its typing errors shares one.

    An edit spoils at most three of the grams (a swap of neighbours), hence three an edit and one.
    ``order`` (gram, n) is a table of at most 38 x 38 grams. Grams it lacks go first.
    """
    n = F.length(word)
    allowed = F.when(n < 3, 0).when(n < 6, 1).otherwise(2)
    each = df.select(word, F.explode(grams(F.col(word))).alias("gram")).join(F.broadcast(order), "gram", "left")
    ranked = each.groupBy(word).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("all"))
    return ranked.select(word, F.explode(F.slice("all", F.lit(1), 3 * allowed + 1)["gram"]).alias("gram"))


def _spread(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in so many partitions that a task has about ``each`` rows: few bytes may be much work."""
    return df.repartition(max(1, min(20_000, math.ceil(rows / each))))


def link(
    names: DataFrame, name: str, register: DataFrame, entry: str, official: str, place: str | None = None, threshold: float = 0.86, canon: naming.Canon | None = None
) -> DataFrame:
    """The rows of ``names`` that mean an entry, with ``entry`` and ``score`` added.

    A row gets the entry of highest soft similarity at or above ``threshold``, of equal ones the
    smallest ``entry``. Null and empty names mean none. With ``place``, the register's column of
    places, variants of kinds are learned from the names unless a ``canon`` is given. Columns of
    ``names`` called as those added are replaced; the register's other columns are not carried. The
    register is a reference table whose vocabulary fits the driver (a few words an entry); the names
    may be any number.
    """
    rows = names.drop(entry, "score")
    raw = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.count("*").alias("__n")).checkpoint()
    if canon is None and place is not None:
        canon = variants.learn(raw, "__name", "__n", register, official, place)
    elif canon is None:
        own = {w for r in register.select(official).filter(F.col(official).isNotNull()).collect() for w in naming.plain(r[0]).split()}
        canon = naming.Canon(kept=frozenset(own - naming.FILLERS))
    distinct = raw.count()
    spelt = _spread(raw, distinct, 5_000).withColumn("__canon", canonical(F.col("__name"), canon)).filter("__canon <> ''").checkpoint()

    entries = (
        register.filter(F.col(official).isNotNull())
        .select(F.col(entry).alias("__entry"), canonical(F.col(official), canon).alias("__text"))
        .filter(F.col("__text") != "")
        .groupBy("__text")
        .agg(F.min("__entry").alias("__entry"))
        .collect()  # the register
    )
    spark = names.sparkSession
    kind = dict(register.dtypes)[entry]
    tokens = {r["__entry"]: r["__text"].split(" ") for r in entries}
    df: dict[str, int] = {}
    for words in tokens.values():
        for w in words:
            df[w] = df.get(w, 0) + 1
    total = len(tokens)
    weight = {w: naming.idf(total, n) for w, n in df.items()}
    rare = naming.idf(total, 1) if total else 1.0
    common = frozenset(w for w, n in df.items() if n >= 3)  # not what tells bodies apart

    def heads(words: list[str]) -> list[str]:
        """The rarest tokens of an entry: without them no name reaches the threshold."""
        # Dice >= threshold leaves at most this much of the entry unmatched
        spare = (2 - 2 * threshold) / (2 - threshold) * sum(weight[t] for t in words)
        out, seen = [], 0.0
        for t in sorted(words, key=lambda t: (-weight[t], t)):
            out.append(t)
            seen += weight[t]
            if seen > spare:
                break
        return out

    known = spark.createDataFrame([(w,) for w in sorted(df)], "known string")
    order = known.select(F.explode(grams(F.col("known"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    index = spark.createDataFrame([(e, w) for e, ws in sorted(tokens.items()) for w in heads(ws)], f"__entry {kind}, known string")

    by_word = spelt.select("__canon").distinct().select("__canon", F.explode(F.split("__canon", " ")).alias("word"))
    vocabulary = by_word.select("word").distinct()
    pairs = (
        _prefixes(vocabulary, "word", order)
        .join(F.broadcast(_prefixes(known, "known", order)), "gram")
        .filter(F.abs(F.length("word") - F.length("known")) <= 2)
        .select("word", "known")
        .distinct()
        .filter(F.levenshtein("word", "known") <= 4)
        .checkpoint()
    )

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([naming.alike(x, y) for x, y in zip(a, b, strict=True)])

    # a word stands for the nearest known words only: one near to two towns is no error of the farther
    near = _spread(pairs, pairs.count(), 20_000).withColumn("sim", alike("word", "known")).filter(F.col("sim") > 0)
    close = near.withColumn("top", F.max("sim").over(Window.partitionBy("word"))).filter(F.col("sim") == F.col("top")).select("word", "known")
    candidates = by_word.join(close, "word").join(F.broadcast(index), "known").select("__canon", "__entry").distinct().checkpoint()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            score = [naming.soft_similarity(c.split(), tokens[e], weight, rare, common) for c, e in zip(frame["__canon"], frame["__entry"], strict=True)]
            yield frame.assign(score=score)

    best = (
        _spread(candidates, candidates.count(), 5_000)
        .mapInPandas(scored, f"__canon string, __entry {kind}, score double")
        .filter(F.col("score") >= threshold)
        .groupBy("__canon")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), "__entry")).alias("best"))
        .select("__canon", F.col("best.__entry").alias(entry), (-F.col("best.neg")).alias("score"))
    )
    named = spelt.join(best, "__canon").select("__name", "__n", entry, "score").checkpoint()
    rows_all = raw.agg(F.sum("__n")).first()[0] or 0
    hot = named.filter(F.col("__n") > rows_all * _HOT).drop("__n")
    rest = named.filter(F.col("__n") <= rows_all * _HOT).drop("__n")
    of = F.col(name) == F.col("__name")
    return rows.join(F.broadcast(hot), of).unionByName(rows.join(F.broadcast(raw.filter(F.col("__n") > rows_all * _HOT).select("__name")), of, "left_anti").join(rest, of)).drop("__name")
