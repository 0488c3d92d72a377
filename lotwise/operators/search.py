"""Selection of notices: filters compiled to an expert query and to a native predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import instants

CPV, COUNTRY, KIND = "classification-cpv", "buyer-country", "notice-type"
PUBLISHED, DEADLINE, TEXT = "publication-date", "deadline-receipt-tender-date-lot", "FT"


#: The most rows of a page, and numbers written into one filter.
MOST = 250


class QueryError(ValueError):
    """A request that cannot be compiled."""


def clamp(value: int, default: int, most: int) -> int:
    """Zero and below mean the default; nothing goes beyond ``most``."""
    return min(default if value <= 0 else value, most)


def cpv_token(token: str) -> tuple[str, bool]:
    """(digits, whether they are a prefix) of a category code as people write it."""
    code = token.strip()
    code = re.sub(r"^(\d{8})-\d$", r"\1", code)
    bare = code.rstrip("Xx*")
    if not bare.isascii() or not bare.isdigit():
        raise QueryError(f"invalid category code {token!r}")
    if len(bare) > 8:
        raise QueryError(f"category code {token!r} has more than 8 digits")
    if len(bare) == 8:
        return bare, False
    if len(bare) < 2:
        raise QueryError(f"category code {token!r} needs at least 2 digits")
    return bare, True


def cpv_tokens(tokens: list[str]) -> tuple[list[str], list[str]]:
    """(exact codes, prefixes), each once, in the order given."""
    exact, prefixes = {}, {}
    for part in tokens:
        for t in re.split(r"[,;\s]+", part):
            if t:
                digits, prefix = cpv_token(t)
                (prefixes if prefix else exact)[digits] = None
    return list(exact), list(prefixes)


def cpv_matches(codes: Column, exact: list[str], prefixes: list[str], hierarchy: bool = False) -> Column:
    """Whether an array of codes has one of them. ``hierarchy``: a code stands for its children too."""
    stems = prefixes + ([c.rstrip("0") for c in exact] if hierarchy else [])
    tests = lambda c: reduce(lambda a, b: a | b, [*([c.isin(exact)] if exact else []), *[c.startswith(p) for p in stems]])
    return F.coalesce(F.exists(codes, tests), F.lit(False))


def compact_date(text: str) -> str:
    """Eight digits of a date written with or without - / and . between them."""
    digits = re.sub(r"[-/.]", "", text.strip())
    if not re.fullmatch(r"\d{8}", digits):
        raise QueryError(f"invalid date {text!r}")
    return digits


def _in(name: str, values: list[str]) -> str:
    return f"{name}={values[0]}" if len(values) == 1 else f"{name} IN ({' '.join(values)})"


@dataclass
class Filters:
    query: str = ""
    cpv: list[str] = field(default_factory=list)
    country: list[str] = field(default_factory=list)
    notice_type: str = ""
    published_from: str = ""
    published_to: str = ""
    deadline_from: str = ""
    deadline_to: str = ""
    keywords: str = ""
    sort_by: str = PUBLISHED
    order: str = "DESC"


@dataclass
class Columns:
    """Where the predicates find their values; publication dates as text that begins yyyy-MM-dd.

    Deadlines may be written in any format; ``deadline_days`` names a column that holds them as an
    array of days yyyyMMdd (a notice has one for each lot), so that they need not be read again.
    """

    cpv: str = "cpv"
    country: str = "buyer_country"
    notice_type: str = "notice_type"
    published: str = "publication_date"
    deadline: str = "deadline"
    deadline_days: str | None = None
    text: tuple[str, ...] = ("title",)


def written_days(date: Column) -> Column:
    """The days yyyyMMdd that dates written in any format name, each once; a text may list several.

    They are those of the written clock, whatever its zone, so that a bound means the same everywhere.
    """

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values)
        found = [sorted({d for part in instants.parts(u) if (d := instants.day_of(part))}) for u in uniques] + [[]]
        return pd.Series([found[c] for c in codes], dtype=object)

    return run(date)


def day_key(text: Column) -> Column:
    return F.replace(F.left(text, F.lit(10)), F.lit("-"), F.lit(""))


def contains_phrase(columns: tuple[str, ...], phrase: str) -> Column:
    both = F.lower(F.concat_ws(" ", *columns))
    return F.contains(both, F.lit(phrase.replace('"', "").strip().lower()))


def _deadline(c: Columns, op: str, day: str) -> Column:
    """Whether any deadline of a notice keeps a bound."""
    days = F.col(c.deadline_days) if c.deadline_days else written_days(F.col(c.deadline))
    test = {"=": lambda d: d == day, ">=": lambda d: d >= day, "<=": lambda d: d <= day}[op]
    return F.coalesce(F.exists(days, test), F.lit(False))


def compile_filters(f: Filters, columns: Columns | None = None, hierarchy: bool = False) -> tuple[str, Column]:
    """The expert query of the filters, and the predicate that says the same."""
    c = columns or Columns()
    clauses: list[str] = []
    tests: list[Column] = []
    if f.query.strip():
        clauses.append(f"({f.query.strip()})")
        tests.append(parse(f.query, c, hierarchy))
    if any(x.strip() for x in f.cpv):
        exact, prefixes = cpv_tokens(f.cpv)
        parts = ([_in(CPV, exact)] if exact else []) + [f"{CPV}={p}*" for p in prefixes]
        clauses.append(parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})")
        tests.append(cpv_matches(F.col(c.cpv), exact, prefixes, hierarchy))
    if f.country:
        codes = [x.strip().upper() for x in f.country if x.strip()]
        if not codes:
            raise QueryError("no country is named")
        clauses.append(_in(COUNTRY, codes))
        tests.append(F.col(c.country).isin(codes))
    if f.notice_type.strip():
        clauses.append(f"{KIND}={f.notice_type.strip()}")
        tests.append(F.col(c.notice_type) == f.notice_type.strip())
    bounds = ((PUBLISHED, ">=", f.published_from), (PUBLISHED, "<=", f.published_to), (DEADLINE, ">=", f.deadline_from), (DEADLINE, "<=", f.deadline_to))
    for name, op, value in bounds:
        if value.strip():
            day = compact_date(value)
            clauses.append(f"{name}{op}{day}")
            if name == PUBLISHED:
                key = day_key(F.col(c.published))
                tests.append(key >= day if op == ">=" else key <= day)
            else:
                tests.append(_deadline(c, op, day))
    if f.keywords.strip():
        clauses.append(f'{TEXT} ~ ("{f.keywords.strip().replace(chr(34), "")}")')
        tests.append(contains_phrase(c.text, f.keywords))
    if not clauses:
        raise QueryError("at least one filter is needed")
    if f.order.upper() not in ("ASC", "DESC"):
        raise QueryError(f"order must be ASC or DESC, not {f.order!r}")
    query = " AND ".join(clauses) + f" SORT BY {f.sort_by or PUBLISHED} {f.order.upper()}"
    return query, reduce(lambda a, b: a & b, tests)


_TOKEN = re.compile(r'\s*(?:(\(|\)|>=|<=|=|~)|"([^"]*)"|([^\s()=~<>"]+))')


def parse(query: str, columns: Columns | None = None, hierarchy: bool = False) -> Column:
    """The predicate of an expert query of ``=``, ``IN``, ``>=``, ``<=``, ``~``, AND, OR and brackets.

    Anything else is refused rather than guessed at.
    """
    c = columns or Columns()
    tokens: list[tuple[str, str]] = []
    at = 0
    text = re.sub(r"\s+SORT\s+BY\s+\S+(\s+(ASC|DESC))?\s*$", "", query.strip())
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"cannot read {text[at:]!r}")
        tokens.append(("op", m[1]) if m[1] else ("phrase", m[2]) if m[2] is not None else ("word", m[3]))
        at = m.end()
    here = 0

    def peek(*wanted: str) -> bool:
        return here < len(tokens) and tokens[here][1] in wanted and tokens[here][0] != "phrase"

    def take(*wanted: str) -> str:
        nonlocal here
        if here >= len(tokens) or (wanted and not peek(*wanted)):
            raise QueryError(f"expected {' or '.join(wanted) or 'a value'} in {query!r}")
        here += 1
        return tokens[here - 1][1]

    def values() -> list[str]:
        if not peek("("):
            return [take()]
        take("(")
        out = []
        while not peek(")"):
            out.append(take())
        take(")")
        if not out:
            raise QueryError("an empty list")
        return out

    def term() -> Column:
        if peek("("):
            take("(")
            inside = either()
            take(")")
            return inside
        name, op = take(), take("=", "IN", ">=", "<=", "~")
        found = values()
        if name == CPV and op in ("=", "IN"):
            return cpv_matches(F.col(c.cpv), *cpv_tokens(found), hierarchy)
        if name in (COUNTRY, KIND) and op in ("=", "IN"):
            return F.col(c.country if name == COUNTRY else c.notice_type).isin(found)
        if name in (PUBLISHED, DEADLINE) and op in ("=", ">=", "<="):
            day = compact_date(found[0])
            if name == DEADLINE:
                return _deadline(c, op, day)
            key = day_key(F.col(c.published))
            return key == day if op == "=" else key >= day if op == ">=" else key <= day
        if name == TEXT and op == "~":
            return contains_phrase(c.text, " ".join(found))
        raise QueryError(f"{name} {op} is not understood")

    def both() -> Column:
        out = term()
        while peek("AND"):
            take("AND")
            out = out & term()
        return out

    def either() -> Column:
        out = both()
        while peek("OR"):
            take("OR")
            out = out | both()
        return out

    out = either()
    if here != len(tokens):
        raise QueryError(f"unexpected {tokens[here][1]!r} in {query!r}")
    return out


SCOPES = ("ALL", "LATEST", "ACTIVE")


def in_scope(notices: DataFrame, scope: str = "ALL", as_of: str | None = None, key: str = "publication_number", version: str = "loaded_at", columns: Columns | None = None) -> DataFrame:
    """The notices of a scope: ALL rows, the LATEST of each number by ``version``, or those of them ACTIVE.

    A notice is active if a deadline of its latest row is on or after the day ``as_of``, which has to be
    given; one without a readable deadline isn't. Rows without a version are older than any; of
    equal ones the row whose values are greatest in order of the columns is kept.
    """
    name = (scope.strip() or "ALL").upper()
    if name not in SCOPES:
        raise QueryError(f"scope must be one of {', '.join(SCOPES)}, not {scope!r}")
    if name == "ALL":
        return notices
    if version not in notices.columns:
        raise QueryError(f"scope {name} needs a column {version} that tells versions of a notice apart")
    rest = [c for c in notices.columns if c not in (key, version)]
    # a hot number is folded on the map side: no window over all its rows
    newest = notices.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__row")).select(*[F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in notices.columns])
    if name == "LATEST":
        return newest
    if not (as_of or "").strip():
        raise QueryError("scope ACTIVE needs the day it is asked for")
    return newest.filter(_deadline(columns or Columns(), ">=", compact_date(as_of)))


def search(notices: DataFrame, filters: Filters, page: int = 1, limit: int = 20, key: str = "publication_number", columns: Columns | None = None) -> tuple[DataFrame, DataFrame]:
    """(the page asked for, a one-row count of all that match); ties are put in order of the key."""
    c = columns or Columns()
    _, predicate = compile_filters(filters, c)
    found = notices.filter(predicate)
    by = {PUBLISHED: c.published, DEADLINE: c.deadline}.get(filters.sort_by, filters.sort_by)
    first = F.col(by).asc_nulls_last() if filters.order.upper() == "ASC" else F.col(by).desc_nulls_last()
    n = clamp(limit, 20, MOST)
    return found.orderBy(first, F.col(key)).offset((max(page, 1) - 1) * n).limit(n), found.agg(F.count("*").alias("total"))


def get_many(notices: DataFrame, numbers: list[str], key: str = "publication_number") -> DataFrame:
    """The notices of all numbers named; unknown ones are silently absent."""
    wanted = list(dict.fromkeys(n.strip() for n in numbers if n.strip()))
    if len(wanted) <= MOST:
        return notices.filter(F.col(key).isin(wanted))
    listed = notices.sparkSession.createDataFrame([(n,) for n in wanted], f"`{key}` string")  # the caller's own list
    return notices.join(F.broadcast(listed), key, "left_semi")
