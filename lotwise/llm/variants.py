"""What people write for the kinds of bodies in a register, learned from the typed names themselves.

Words that stand beside the same place mean the same kind. Each typed name is cut, at its marks and
at the register's place it names, into phrases. A phrase is

- a variant of a kind, if the share of its names whose place has that kind in the register is nearly
  as high as for names that spell the kind officially (bodies that are not registered keep both below
  1; the phrase of another kind, or of no registered one, falls far behind), or, with less evidence,
  if it is an abbreviation of it by its letters;
- a unit within bodies, if it stands apart from the place, beside official kinds of more than one
  sort, and so names no kind of its own.

All names are counted. What is learned is as large as the register's kinds have frequent variants:
phrases of fewer than ``RARE`` of the names that name a place are not considered.
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

from lotwise.llm import naming

#: The least share of all placed names that a phrase must occur in (three at least).
RARE = 1 / 20_000
#: Places in which a phrase is taken to mean no kind in particular, before any are seen.
_DOUBT = 3
_MARKS = re.compile(r"\s[-–—]\s|[(),;:\"/]")


def content(text: str) -> tuple[str, ...]:
    return tuple(w for w in naming.plain(text).split() if w not in naming.FILLERS)


class Gazetteer:
    """The places of a register, and the kinds of bodies registered in each."""

    def __init__(self, entries: list[tuple[str, str | None]]):
        self.kinds_at: dict[tuple[str, ...], set[tuple[str, ...]]] = defaultdict(set)
        for official, place in entries:
            p, whole = content(place or ""), content(official or "")
            at = next((i for i in range(len(whole) - len(p) + 1) if p and whole[i : i + len(p)] == p), None)
            if at is not None and len(whole) > len(p):
                self.kinds_at[p].add(whole[:at] + whole[at + len(p) :])
        self.places = sorted(self.kinds_at)
        self.kinds = sorted({k for v in self.kinds_at.values() for k in v})
        self.number = {k: i for i, k in enumerate(self.kinds)}
        self.has = np.zeros((len(self.places), len(self.kinds)), dtype=bool)
        for i, p in enumerate(self.places):
            for k in self.kinds_at[p]:
                self.has[i, self.number[k]] = True
        self.by_head: dict[str, list[tuple[tuple[str, ...], int]]] = defaultdict(list)
        for i, p in enumerate(self.places):
            self.by_head[p[0]].append((p, i))
        for found in self.by_head.values():
            found.sort(key=lambda x: -len(x[0]))  # the longest name of a place goes first

    def phrases(self, name: str) -> tuple[int | None, list[tuple[tuple[str, ...], bool]]]:
        """The place a name names, and its phrases; whether each stands apart from the place."""
        where, out = None, []
        for segment in _MARKS.split(name):
            words, i = content(segment), 0
            begin, met = len(out), False
            current: list[str] = []
            while i < len(words):
                hit = next(((p, n) for p, n in self.by_head.get(words[i], ()) if words[i : i + len(p)] == p and where in (None, n)), None)
                if hit is None:
                    current.append(words[i])
                    i += 1
                    continue
                where, met = hit[1], True
                i += len(hit[0])
                if current:
                    out.append((tuple(current), False))
                    current = []
            if current:
                out.append((tuple(current), not met))
            if met:
                out[begin:] = [(p, False) for p, _ in out[begin:]]
        return where, out


def abbreviates(short: tuple[str, ...], kind: tuple[str, ...]) -> bool:
    """Whether a phrase is a kind's initials, or its words one by one in full or shortened."""
    if len(short) == 1 and len(kind) > 1 and short[0] == "".join(w[0] for w in kind):
        return True
    return short != kind and len(short) == len(kind) and all(a == b or naming.shortens(a, b) for a, b in zip(short, kind, strict=True))


def _misspelt(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether each word of a is the word of b, or it with typing errors."""
    return len(a) == len(b) and all(naming.distance(x, y, naming.allowed(y)) <= naming.allowed(y) for x, y in zip(a, b, strict=True))


def decide(stats: list[tuple[tuple[str, ...], dict[int, int], int, int, int]], register: Gazetteer, near: float = 0.7, least: float = 0.4) -> tuple[dict[tuple[str, ...], tuple[str, ...]], list[tuple[str, ...]]]:
    """(kind of each variant, units) of phrases: (phrase, names by place, apart, beside a kind, kinds beside as bits).

    ``near``: how close to the official spelling's share a variant's must come; ``least``: the same
    for abbreviations, which need no second place.
    """
    by = {p: n for p, n, *_ in stats}

    def shares(places: dict[int, int]) -> np.ndarray:
        at = np.fromiter(places, dtype=int)
        weight = np.log2(1.0 + np.fromiter(places.values(), dtype=float))  # one busy place says little
        return (register.has[at] * weight[:, None]).sum(axis=0) / weight.sum()

    usual = np.array([shares(by[k])[i] if k in by else np.nan for i, k in enumerate(register.kinds)])
    usual = np.where(np.isnan(usual) | (usual <= 0), np.nanmean(usual) if (usual > 0).any() else 1.0, usual)
    base = register.has.mean(axis=0)
    often = {p: sum(n.values()) for p, n in by.items()}
    variants: dict[tuple[str, ...], tuple[str, ...]] = {}
    units = []
    for phrase, places, apart, beside, bits in sorted(stats, key=lambda s: (-sum(s[1].values()), s[0])):
        n = sum(places.values())
        if phrase in register.number or any(n <= 0.2 * max(often.get(known, 0), 5) and _misspelt(phrase, known) for known in [*register.kinds, *variants]):
            continue  # misspelt phrases are corrected word by word
        if beside >= 0.2 * n:  # it goes with kinds, so it is none: a unit, or a part of a place's name
            if apart >= 0.5 * n and bits.bit_count() >= 2:
                units.append(phrase)
            continue
        share = shares(places)
        ratio = share / usual
        sure = (share * len(places) + _DOUBT * base) / (len(places) + _DOUBT) / usual
        best = int(sure.argmax())
        if not (len(places) >= 3 and sure[best] >= near):
            fits = [i for i, k in enumerate(register.kinds) if ratio[i] >= least and abbreviates(phrase, k)]
            if not fits:
                continue
            best = max(fits, key=lambda i: ratio[i])
        variants[phrase] = register.kinds[best]
    return variants, units


def learn(names: DataFrame, name: str, count: str, register: DataFrame, official: str, place: str) -> naming.Canon:
    """The rewriting rules learned from distinct ``names`` with their ``count``.

    ``register`` is a reference table; rows without a name or place say nothing. Without names that
    name a place nothing is learned, and only the register's own words count.
    """
    entries = [(r[0], r[1]) for r in register.select(official, place).collect() if r[0]]
    gazetteer = Gazetteer(entries)
    kept = frozenset(w for o, _ in entries for w in content(o))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for text, n in zip(frame["name"], frame["n"], strict=True):
                where, found = gazetteer.phrases(text)
                if where is None:
                    continue
                official_kinds = {p for p, _ in found if p in gazetteer.number}
                for phrase, apart in set(found):
                    others = [gazetteer.number[k] for k in official_kinds if k != phrase]
                    rows.append((" ".join(phrase), where, n, n * apart, n * bool(others), sum(1 << (k % 62) for k in others)))
                rows.append(("", where, n, 0, 0, 0))
            yield pd.DataFrame(rows, columns=["phrase", "place", "n", "apart", "beside", "kinds"])

    rows = names.select(F.col(name).alias("name"), F.col(count).alias("n")).filter(F.col("name").isNotNull())
    found = rows.mapInPandas(run, "phrase string, place int, n bigint, apart bigint, beside bigint, kinds bigint")
    by_place = found.groupBy("phrase", "place").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"), F.sum("beside").alias("beside"), F.bit_or("kinds").alias("kinds")).persist()
    placed = by_place.filter("phrase = ''").agg(F.sum("n")).first()[0] or 0
    enough = max(1, math.ceil(placed * RARE))
    # the places of a phrase are at most the register's
    whole = (
        by_place.filter("phrase <> ''").groupBy("phrase")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("places"), F.sum("apart").alias("apart"), F.sum("beside").alias("beside"), F.bit_or("kinds").alias("kinds"), F.sum("n").alias("n"))
        .filter((F.col("n") >= enough) & ((F.size("places") >= 3) | (F.length("phrase") <= 24)))
    )
    stats = [(tuple(r.phrase.split()), r.places, r.apart, r.beside, r.kinds) for r in whole.collect()]
    by_place.unpersist()
    if not gazetteer.kinds:
        return naming.Canon(kept=kept)
    variants, units = decide(stats, gazetteer)
    kinds = {k: k for k in gazetteer.kinds} | variants
    return naming.Canon(kinds=kinds, units=units, kept=kept)
