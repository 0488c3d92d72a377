"""Language-scoped text search as native columns.

A text is searched only with the terms of its own declared language and those marked ``*``; a text
without a language is searched with all. Terms go before proximity pairs, the leftmost hit wins.
Positions are code points counted from 1; the distance of a pair is counted in UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY = "*"
WINDOW = 60
HIT = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pair", T.BooleanType())])

#: Unicode white space, which ``\s`` alone is not here.
SPACE = r"[\s\x{85}\p{Z}]+"


def fold(text: Column) -> Column:
    """Lower case with one form of sigma, as positions in it must be those of the text."""
    return F.translate(F.lower(F.replace(text, F.lit("İ"), F.lit("I"))), "ς", "σ")


def fold_term(term: str) -> str:
    return term.replace("İ", "I").lower().replace("ς", "σ")


def language(lang: Column) -> Column:
    return F.upper(F.trim(F.coalesce(lang, F.lit(""))))


def _clean(groups: dict[str, list[str]] | None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, terms in (groups or {}).items():
        kept = [fold_term(t.strip()) for t in terms if t.strip()]
        if kept:
            key = lang.strip().upper() or ANY
            out[key] = list(dict.fromkeys(out.get(key, []) + kept))
    return out


@dataclass
class Spec:
    """Terms by language, and pairs of roots by language that must lie within ``window`` bytes."""

    terms: dict[str, list[str]] = field(default_factory=dict)
    near_a: dict[str, list[str]] = field(default_factory=dict)
    near_b: dict[str, list[str]] = field(default_factory=dict)
    window: int = WINDOW

    def __post_init__(self) -> None:
        self.terms, self.near_a, self.near_b = _clean(self.terms), _clean(self.near_a), _clean(self.near_b)
        self.window = self.window or WINDOW

    @property
    def empty(self) -> bool:
        """Whether there is nothing to look for: roots of one side alone (b) don't count."""
        return not self.terms and not self.near_a

    def languages(self) -> list[str]:
        return sorted({*self.terms, *self.near_a, *self.near_b})


def _of(groups: dict[str, list[str]], lang: str | None) -> list[str]:
    """The terms for a language; for None, of all languages in order of their codes."""
    names = sorted(groups) if lang is None else [lang, ANY]
    return list(dict.fromkeys(t for n in names for t in groups.get(n, [])))


def _hits(text: Column, terms: list[str]) -> Column:
    each = [F.struct(F.locate(t, text).alias("start"), F.lit(i).alias("ord"), F.lit(t).alias("term"), F.lit(len(t)).alias("len"), F.lit(len(t.encode())).alias("bytes")) for i, t in enumerate(terms)]
    return F.filter(F.array(*each), lambda h: h["start"] > 0)


def _none() -> Column:
    return F.lit(None).cast(HIT)


def _hit(term: Column, start: Column, end: Column, pair: bool) -> Column:
    return F.struct(term.alias("term"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(pair).alias("pair"))


def bound(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _term_hit(text: Column, terms: list[str]) -> Column:
    if not terms:
        return _none()
    hit = lambda first: F.when(first.isNotNull(), _hit(first["term"], first["start"], first["start"] + first["len"], False))
    return bound(F.array_min(_hits(text, terms)), hit)


def _pair_hit(text: Column, a: list[str], b: list[str], window: int) -> Column:
    """Only the first occurrence of each root counts; roots that overlap are no pair."""
    if not a or not b:
        return _none()

    def placed(terms: list[str]) -> Column:
        one = lambda h: bound(
            F.octet_length(F.substring(text, F.lit(1), h["start"] - 1)),
            lambda at: F.struct(h["start"], h["ord"], h["term"], (h["start"] + h["len"]).alias("end"), at.alias("b0"), (at + h["bytes"]).alias("b1")),
        )
        return F.transform(_hits(text, terms), one)

    def joined(x: Column, y: Column) -> Column:
        gap = F.greatest(y["b0"] - x["b1"], x["b0"] - y["b1"])
        return F.struct(
            F.least(x["start"], y["start"]).alias("start"),
            x["ord"].alias("a"),
            y["ord"].alias("b"),
            F.greatest(x["end"], y["end"]).alias("end"),
            F.concat(x["term"], F.lit(" + "), y["term"]).alias("term"),
            gap.alias("gap"),
        )

    def nearest(right: Column) -> Column:
        all_pairs = F.flatten(F.transform(placed(a), lambda x: F.transform(right, lambda y: joined(x, y))))
        return F.array_min(F.filter(all_pairs, lambda p: (p["gap"] >= 0) & (p["gap"] <= window)))

    hit = lambda first: F.when(first.isNotNull(), _hit(first["term"], first["start"], first["end"], True))
    return bound(bound(placed(b), nearest), hit)


class LanguageMatcher:
    def __init__(self, spec: Spec):
        self.spec = spec

    def _by_language(self, lang: Column, make) -> Column:
        code = language(lang)
        out = F.when(code == "", make(None))
        for name in self.spec.languages():
            if name != ANY:
                out = out.when(code == name, make(name))
        return out.otherwise(make(ANY))

    def find(self, text: Column, lang: Column) -> Column:
        """The leftmost hit, or null: struct<term, start, end, pair>."""
        s = self.spec

        def hit(low: Column) -> Column:
            return F.coalesce(
                self._by_language(lang, lambda n: _term_hit(low, _of(s.terms, n))),
                self._by_language(lang, lambda n: _pair_hit(low, _of(s.near_a, n), _of(s.near_b, n), s.window)),
            )

        return bound(fold(text), hit)  # folded once and not for each term

    def covers(self, lang: Column) -> Column:
        """Whether a language was searched at all; a text without one always is."""
        known = {*self.spec.terms, *self.spec.near_a}
        if ANY in known:
            return F.lit(True)
        return (language(lang) == "") | language(lang).isin(sorted(known))

    def describe(self) -> str:
        """What is looked for; parts there are none of are left out."""
        s = self.spec
        count = lambda g: sum(map(len, g.values()))
        parts = [f"{count(s.terms)} term(s)"] if s.terms else []
        if s.near_a or s.near_b:
            parts.append(f"{count(s.near_a)}+{count(s.near_b)} paired root(s) within {s.window} chars")
        return f"{', '.join(parts)} across {len(s.languages())} language(s)" if parts else "empty search"


_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def translate_regex(pattern: str) -> str:
    """A linear-time-engine pattern as one of this JVM: Unicode case folding, ASCII word bounds.

    Case doesn't count unless the pattern begins with its own group or flags. Look-around and back
    references are refused, as is what doesn't parse.
    """
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise ValueError(f"unsupported regular expression: {pattern}")
    try:
        re.compile(re.sub(r"\\[pP](\{\w+\}|\w)|\\x\{[0-9A-Fa-f]+\}|\\z", "x", pattern))
    except re.error as e:
        raise ValueError(f"invalid regular expression: {e}") from e
    body = re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m.group(1) + _BOUNDARY, pattern)
    if body.startswith("(?i)"):
        return "(?iu)" + body[4:]
    return body if body.startswith("(?") else "(?iu)" + body


class RegexMatcher:
    """One expression for every language."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.java = translate_regex(pattern)

    def find(self, text: Column, lang: Column) -> Column:
        found = F.regexp_extract(text, f"({self.java})" if not self.java.startswith("(?iu)") else f"(?iu)({self.java[5:]})", 1)
        at = F.regexp_instr(text, F.lit(self.java))
        return F.when(text.rlike(self.java), _hit(found, at, at + F.length(found), False))

    def covers(self, lang: Column) -> Column:
        return F.lit(True)

    def describe(self) -> str:
        return f"regular expression {self.pattern}"


def matcher(language_terms: dict | None = None, terms: list[str] | None = None, near: dict | None = None, regex: str | None = None):
    """The matcher of a request: a spec goes before an expression; None if there is neither."""
    by_language = {k: list(v) for k, v in (language_terms or {}).items()}
    if terms:
        by_language[ANY] = by_language.get(ANY, []) + list(terms)
    near = near or {}
    spec = Spec(by_language, near.get("a", {}), near.get("b", {}), near.get("window", WINDOW))
    if not spec.empty:
        return LanguageMatcher(spec)
    return RegexMatcher(regex) if regex else None


def snippet(text: Column, hit: Column, around: int = 180) -> Column:
    """The hit with ``around`` characters on both sides, and … where the text goes on."""
    begin = F.greatest(hit["start"] - around, F.lit(1))
    end = F.least(hit["end"] + around, F.length(text) + 1)
    body = strip(F.substring(text, begin, end - begin))
    return F.concat(F.when(begin > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise(""))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, SPACE, " "))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(strip(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


def passage_key(text: Column, most: int = 80) -> Column:
    """What tells passages apart: the beginning, without ellipses and case."""
    return F.left(F.lower(F.regexp_replace(text, r"^[…\s\x{85}\p{Z}]+|[…\s\x{85}\p{Z}]+$", "")), F.lit(most))


def dehyphenate(text: Column) -> Column:
    """Words divided at a line's end are joined; soft hyphens go."""
    return F.regexp_replace(F.replace(text, F.lit("\u00ad"), F.lit("")), r"(\p{L})-[ \t]*[\r\n]+[ \t]*(\p{L})", "$1$2")
