"""Scans: evidence of a matcher in texts, deduplicated, capped and honestly accounted for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import textmatch

MATCHES, AROUND, CRITERION = 12, 180, 500


def evidence(texts: DataFrame, matcher, group: list[str], order: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The texts with a hit: term, start and snippet beside their other columns."""
    # exploded rather than filtered: a filter would be pushed below the projection, and every text searched twice
    hits = F.array_compact(F.array(matcher.find(F.col(text), F.col(lang))))
    found = texts.select("*", F.explode(hits).alias("__hit"))
    return found.select(*group, *order, lang, text, F.col("__hit.term").alias("term"), F.col("__hit.start").alias("start"), textmatch.snippet(F.col(text), F.col("__hit"), AROUND).alias("snippet"))


def first_of_each(rows: DataFrame, group: list[str], key: Column, order: list[str]) -> DataFrame:
    """Of equal keys in a group, the first in order."""
    window = Window.partitionBy(*group, "__key").orderBy(*order)
    return rows.withColumn("__key", key).withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__key", "__n")


def top(rows: DataFrame, group: list[str], order: list[str], most: int = MATCHES) -> DataFrame:
    """The first ``most`` of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= most)


def without_covered(rows: DataFrame, covering: DataFrame, group: list[str], text: str, by: str) -> DataFrame:
    """Rows whose text isn't part of a covering text of the same group."""
    held = covering.groupBy(*group).agg(F.collect_set(F.lower(by)).alias("__held"))
    joined = rows.join(held, group, "left")
    inside = F.coalesce(F.exists("__held", lambda c: F.contains(c, F.lower(F.col(text)))), F.lit(False))
    return joined.filter(~inside).drop("__held")


def notices(criteria: DataFrame, texts: DataFrame, matcher, key: str, most: int = MATCHES) -> DataFrame:
    """(key, tier, seq, lang, term, snippet, place): evidence of notices, criteria before other texts.

    ``criteria`` has key, seq, lang and text, ``texts`` the same with a tier of 2 or more. A passage
    is reported once, a text within a reported criterion not at all, and no more than ``most``.
    """
    first = evidence(criteria.withColumn("tier", F.lit(1)), matcher, [key], ["tier", "seq"])
    first = top(first_of_each(first, [key], textmatch.passage_key(F.col("snippet")), ["seq"]), [key], ["seq"], most).drop("place")
    rest = without_covered(evidence(texts, matcher, [key], ["tier", "seq"]), first, [key], "text", "text")
    both = first.unionByName(rest)
    fresh = first_of_each(both, [key], textmatch.passage_key(F.col("snippet")), ["tier", "seq"])
    return top(fresh, [key], ["tier", "seq"], most).select(key, "tier", "seq", "lang", "term", "snippet", "place")


def uncovered(texts: DataFrame, matcher, lang: str = "lang") -> DataFrame:
    """How many texts of each language were not searched."""
    code = textmatch.language(F.col(lang))
    return texts.filter((code != "") & ~matcher.covers(F.col(lang))).groupBy(code.alias("language")).agg(F.count("*").alias("texts"))


def accounting(texts: DataFrame, matcher, readable: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row: scanned, unreadable, not searched, and matched texts."""
    code = textmatch.language(F.col(lang))
    hit = matcher.find(F.col(text), F.col(lang)).isNotNull()
    covered = matcher.covers(F.col(lang))
    counts = {
        "scanned": F.lit(True),
        "unreadable": ~readable,
        "uncovered": readable & (code != "") & ~covered,
        "matched": readable & hit,
    }
    return texts.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Tables of the same columns below one another, with the number of their part."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
