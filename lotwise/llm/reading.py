"""Reading level: share of unfamiliar words plus average sentence length, calibrated on samples.

The familiar words of a language are those of high document frequency where sentences are short. All
documents are counted, undeclared ones in the language they are told to be of: for each word, the
frequency is a line over ``ease`` (1 up to the sentence length usual on the easiest level of the
samples, falling to 0 as sentences grow), fitted to all documents and read at the greatest ease found (at most three standard deviations above
the mean, so that a few odd documents can't lead it). Where all documents are equally easy it is the
plain frequency. Rare words can't reach ``min_share``, so the list is small whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+")
_JOINED = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?=[^\W\d_])")
_END = re.compile(r"(?<=\w\w\w[.!?;:])[\"»)]*\s+(?=[^a-zà-ÿ])|\n\s*\n|\n(?=\s*(?:[-•*–]|\d{1,3}[.)])\s)")


def measure(text: str) -> tuple[list[str], float]:
    """The lower-case words of a text, and the words a sentence (0 for a text without words)."""
    if "\n" in text:
        text = _JOINED.sub("", text)
    words = _WORD.findall(text.lower())
    sentences = sum(1 for s in _END.split(text) if s and _WORD.search(s))
    return words, len(words) / max(1, sentences) if words else 0.0


def features(words: list[str], length: float, familiar: frozenset[str]) -> tuple[float, float]:
    return sum(w not in familiar for w in words) / max(1, len(words)), math.log1p(length)


class Levels:
    """Gaussian classes over the two features with one pooled covariance (a linear rule)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.levels = np.unique(y)
        self.means = np.array([x[y == k].mean(axis=0) for k in self.levels])
        rest = x - self.means[np.searchsorted(self.levels, y)]
        pooled = rest.T @ rest / max(1, len(x) - len(self.levels)) + 1e-4 * np.eye(x.shape[1])
        self.inverse = np.linalg.inv(pooled)

    def of(self, x: np.ndarray) -> np.ndarray:
        gap = x[:, None, :] - self.means[None]
        return self.levels[np.einsum("nki,ij,nkj->nk", gap, self.inverse, gap).argmin(axis=1)]


def cuts(samples: list[tuple[str, int, str]]) -> dict[str, float]:
    """By language: the mean sentence length of the easiest level."""
    by: dict[str, dict[int, list[float]]] = defaultdict(lambda: defaultdict(list))
    for lang, level, text in samples:
        by[lang][level].append(math.log1p(measure(text)[1]))
    out = {}
    for lang, levels in by.items():
        out[lang] = math.expm1(float(np.mean(levels[min(levels)])))
    return out


def fit(samples: list[tuple[str, int, str]], lists: dict[str, frozenset[str]]) -> dict[str, Levels]:
    by = defaultdict(list)
    for lang, level, text in samples:
        by[lang].append((features(*measure(text), lists.get(lang, frozenset())), level))
    return {lang: Levels(np.array([f for f, _ in rows]), np.array([k for _, k in rows])) for lang, rows in by.items()}


def vocabulary(samples: list[tuple[str, int, str]]) -> dict[str, frozenset[str]]:
    """By language: the words of its samples, by which languages are told."""
    out: dict[str, set[str]] = defaultdict(set)
    for lang, _, text in samples:
        out[lang].update(measure(text)[0])
    return {k: frozenset(v) for k, v in out.items()}


def language(declared: str | None, words: list[str], lists: dict[str, frozenset[str]]) -> str:
    """The declared language if it has a list, else the one whose list knows most of the words."""
    code = (declared or "").strip().lower()[:2]
    if code in lists:
        return code
    return max(sorted(lists), key=lambda k: sum(w in lists[k] for w in words))


def ease(length: float, limit: float) -> int:
    """How easy a text of so many words a sentence is, in thousandths: sums of it are exact in any order."""
    return round(1000 * min(1.0, limit / length) ** 4)


def familiar_words(
    documents: DataFrame, text: str, lang: str, limits: dict[str, float], min_share: float = 0.2, known: dict[str, frozenset[str]] | None = None
) -> dict[str, frozenset[str]]:
    """By language: the words whose document frequency, read for the easiest documents, is ``min_share`` or more.

    All documents with words are counted. Those not declared as one of ``limits`` are told by
    ``known``, the words of each language; without it they are not counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, dict[str, list[int]]] = defaultdict(dict)
        for frame in batches:
            for code, body in zip(frame["lang"], frame["text"], strict=True):
                code = (code or "").strip().lower()[:2]
                if not body or (code not in limits and not known):
                    continue
                words, length = measure(body)
                if not words:
                    continue
                own = code if code in limits else language(None, words, known)
                x, into = ease(length, limits[own]), counts[own]
                for w in ("", *set(words)):
                    if (c := into.get(w)) is None:
                        into[w] = [1, x, x * x, x]
                    else:
                        c[0] += 1
                        c[1] += x
                        c[2] += x * x
                        c[3] = max(c[3], x)
            if sum(map(len, counts.values())) > 500_000:
                yield _rows(counts)
                counts.clear()
        yield _rows(counts)

    def _rows(counts: dict[str, dict[str, list[int]]]) -> pd.DataFrame:
        return pd.DataFrame([(c, w, *n) for c, ws in counts.items() for w, n in ws.items()], columns=["lang", "word", "n", "x", "xx", "top"])

    found = (
        documents.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .mapInPandas(run, "lang string, word string, n bigint, x bigint, xx bigint, top bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.max("top").alias("top"))
        .persist()  # read twice below; else the documents would be counted twice
    )
    total = found.filter("word = ''").select("lang", F.col("n").alias("of"), (F.col("x") / F.col("n")).alias("mean"), (F.col("xx") / F.col("n")).alias("square"), F.col("top").alias("most"))
    spread = F.col("square") - F.col("mean") ** 2
    slope = F.when(spread > 1, (F.col("x") / F.col("of") - F.col("mean") * F.col("n") / F.col("of")) / spread).otherwise(0.0)
    at = F.least(F.col("most").cast("double"), F.col("mean") + 3 * F.sqrt(F.greatest(spread, F.lit(0.0))))  # never beyond the documents, nor led by a few of them
    share = F.col("n") / F.col("of") + slope * (at - F.col("mean"))
    common = found.drop("top").join(F.broadcast(total), "lang").filter((F.col("word") != "") & (share >= min_share))
    lists: dict[str, set[str]] = {k: set() for k in limits}
    for r in common.select("lang", "word").collect():
        lists[r.lang].add(r.word)
    found.unpersist()
    return {k: frozenset(v) for k, v in lists.items()}


def levels(documents: DataFrame, key: str, text: str, lang: str, samples: DataFrame, min_chars: int = 0) -> DataFrame:
    """(key, level, unfamiliar, sentence): the level of each document of at least ``min_chars``.

    Null and shorter texts are left out; a text without words gets the easiest level. Undeclared
    languages are told by the samples' words. ``samples`` (lang, level, text) is a bounded table of labelled
    passages (the rule's two features and four classes need a few dozen a language).
    """
    labelled = [(r.lang.strip().lower()[:2], int(r.level), r.text) for r in samples.select("lang", "level", "text").collect() if r.lang and r.text]
    known = vocabulary(labelled)
    lists = familiar_words(documents, text, lang, cuts(labelled), known=known)
    rules = fit(labelled, lists)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for k, code, body in zip(frame["key"], frame["lang"], frame["text"], strict=True):
                words, length = measure(body)
                own = language(code, words, known)
                rows.append((k, own, *features(words, length, lists[own]), length, not words))
            out = pd.DataFrame(rows, columns=["key", "own", "u", "l", "sentence", "empty"])
            out["level"] = 0
            for own, part in out.groupby("own"):
                out.loc[part.index, "level"] = np.where(part["empty"], rules[own].levels[0], rules[own].of(part[["u", "l"]].to_numpy()))
            yield out.rename(columns={"u": "unfamiliar"})[["key", "level", "unfamiliar", "sentence"]]

    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    scored = rows.filter(F.col("text").isNotNull() & (F.length("text") >= min_chars)).mapInPandas(run, f"key {kind}, level int, unfamiliar double, sentence double")
    return scored.withColumnRenamed("key", key)
