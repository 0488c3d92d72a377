"""Matching records of two tables that share no key, with a confidence for each match.

Attributes are encoded as fixed bit vectors: the title's token q-grams in ``CHUNKS`` chunks of
``WIDTH`` bits, every number of the title setting a bit in each chunk (numbers tell lots apart) and in
a vector of their own, the buyer's code and the category's group one bit for each digit in its place;
amounts are steps of 1 %, days the numbers they are.

Close pairs are found exactly by multi-index hashing over these parts. Titles at a Hamming distance
below ``CHUNKS`` agree in a whole chunk, so

- titles within five bits are met if the code or the amount step (or the next to it) is the same,
- titles within two bits (two neighbouring chunks agree) if the day is, up to one apart,
- titles of the same words that name one thing by themselves, and
- records of any titles if three of code, amount step, category group and day agree, days up to one apart
  (code, amount and group; amount, day and group; amount, day and code).

Chunks are never looked up alone, so buckets stay small however many records one buyer has.

The Dice similarities of the vectors of each pair met, of amounts their ratio, are reduced to levels, and
a mixture fitted by EM to the counts of level patterns over all pairs gives each field's weight and
each pattern's probability of being a match; pairs alike by chance have a class for each kind of bucket.
A record's rivals then share its confidence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import instants

CHUNKS, WIDTH = 6, 40
#: Ratio of neighbouring amount buckets.
_STEP = math.log(1.01)
# What announces a procurement, in full and short forms.
_HEADS = re.compile(
    r"\b(accordo quadro|affidamento del servizio|procedura aperta|appalto|fornitura|servizio|servizi"
    r"|app|forn|serv|aff|proc|aq|pa|acc quadro|framework|contract|provision|purchase)\b"
)
_STOP = frozenset("di del dei degli della delle per la il lo le gli e a al da in su con n rif".split())


def title_words(text: str | None) -> tuple[list[str], list[str]]:
    """(words, numbers) of a title without its opening formula, in no order; codes are numbers.

    The number behind the word for a lot is one of its own kind, apart from equal quantities.
    """
    if not text:
        return [], []
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    if "." in low:
        low = re.sub(r"(?<=[a-z])\.(?=[a-z])", "", low)
    low = re.sub(r"\blotto\s+(\d+)", r" lot\1 ", re.sub(r"[^a-z0-9-]+", " ", low))
    low = _HEADS.sub(" ", low.replace(" - ", " "))
    found = low.split()
    numbers = sorted({w.strip("-") for w in found if any(c.isdigit() for c in w)})
    return sorted({w.strip("-") for w in found if not any(c.isdigit() for c in w)} - _STOP - {""}), numbers


#: Bit masks of words and numbers already met in this process.
_MASKS: dict[str, int] = {}


def _mask(key: str) -> int:
    """The bits of a word's q-grams, or behind # the bits of a number: one in each chunk."""
    found = _MASKS.get(key)
    if found is None:
        found = 0
        if key[0] == "#":
            h = xxhash.xxh3_64_intdigest(key)
            for k in range(CHUNKS):
                found |= 1 << (k * WIDTH + (h >> (8 * k)) % WIDTH)
        else:
            padded = f"_{key}_"
            for i in range(len(padded) - 1):
                found |= 1 << (xxhash.xxh3_64_intdigest(padded[i : i + 2]) % (CHUNKS * WIDTH))
        if len(_MASKS) > 500_000:
            _MASKS.clear()
        _MASKS[key] = found
    return found


def vectors(text: str | None) -> tuple[list[int] | None, int, int | None]:
    """(the title's chunks, a bitmap of its numbers, the whole of a title that may name one thing).

    No chunks for a title without words; the whole only where it has a number or three words or more.
    """
    ws, numbers = title_words(text)
    bits = 0
    for n in numbers:
        bits |= 1 << (xxhash.xxh3_64_intdigest("n" + n) % 63)
    if not ws:
        return None, bits, None
    joined = 0
    for key in [*ws, *["#" + n for n in numbers]]:
        joined |= _mask(key)
    only = any(not n.startswith("lot") for n in numbers) or len(ws) >= 3
    whole = xxhash.xxh3_64_intdigest(" ".join([*ws, *numbers])) - 2**63 if only else None
    return [(joined >> (k * WIDTH)) & ((1 << WIDTH) - 1) for k in range(CHUNKS)], bits, whole


def code_digits(text: str | None, length: int = 11) -> str | None:
    """The digits of a code written with decorations, leading zeros restored; None without enough."""
    digits = re.sub(r"\D", "", text or "")
    return digits.zfill(length) if length - 3 <= len(digits) <= length and digits.strip("0") else None


def digit_bits(digits: str | None, places: tuple[int, ...]) -> list[int] | None:
    """Vectors of so many places each in which every digit sets the bit of its place and value."""
    if not digits:
        return None
    out, at = [], 0
    for n in places:
        out.append(sum(1 << (10 * i + int(c)) for i, c in enumerate(digits[at : at + n])))
        at += n
    return out


def day(text: str | None) -> int | None:
    """The day of a written date, with or without a time of day."""
    if not text:
        return None
    found = instants.readings(text)
    if found:
        return found[0][1] // 86400
    plain = instants.split_zone(instants._tidy(text))[0]
    days = instants.dates(plain)
    return days[0][1] if days else None


def buckets(around: bool) -> Column:
    """The buckets an encoded record lies in; ``around``: those of amounts up to one step and days up to one off as well."""
    step = F.floor(F.log("amount") / _STEP)
    steps = [step - 1, step, step + 1] if around else [step]
    days = [F.col("day") - 1, F.col("day"), F.col("day") + 1] if around else [F.col("day")]
    group = F.col("cpv")
    have = lambda value, *needed: F.when(sum((F.col(c).isNull().cast("int") for c in needed), F.lit(0)) == 0, value)
    chunk = [F.col(c) for c in TITLE]
    out = []
    for s in steps:
        out.append(have(F.xxhash64(F.lit(1), *CODE, s, group), "c0", "amount", "cpv"))
        out += [have(F.xxhash64(F.lit(5), s, d, group), "amount", "day", "cpv") for d in days]
        out += [have(F.xxhash64(F.lit(6), s, d, *CODE), "amount", "day", "c0") for d in days]
        out += [have(F.xxhash64(F.lit(3), s, F.lit(i), c), "amount", "t0") for i, c in enumerate(chunk)]
    out += [have(F.xxhash64(F.lit(2), *CODE, F.lit(i), c), "c0", "t0") for i, c in enumerate(chunk)]
    out.append(have(F.xxhash64(F.lit(7), "whole"), "whole"))
    out += [have(F.xxhash64(F.lit(4), d, F.lit(i), chunk[i], chunk[i + 1]), "day", "t0") for i in range(0, CHUNKS, 2) for d in days]
    return F.array_compact(F.array(*out))


#: The columns of an encoded title and code; null together.
TITLE, CODE = [f"t{i}" for i in range(CHUNKS)], ["c0", "c1"]
_SCHEMA = "id bigint, " + ", ".join(f"{c} bigint" for c in TITLE) + ", numbers bigint, whole bigint, c0 bigint, c1 bigint, amount double, cpv bigint, day int"


def encode(records: DataFrame) -> DataFrame:
    """Vectors of records (id, title, code, amount, cpv, date); any attribute may be null."""

    def each(values: pd.Series, of) -> list:
        """``of`` each value, worked out once for equal ones."""
        codes, uniques = pd.factorize(values)
        found = [*map(of, uniques), of(None)]
        return [found[c] for c in codes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            titles = each(frame["title"], vectors)
            out = pd.DataFrame({"id": frame["id"]})
            for i in range(CHUNKS):
                out[f"t{i}"] = pd.array([None if c is None else c[i] for c, _, _ in titles], dtype="Int64")
            out["numbers"] = [n for _, n, _ in titles]
            out["whole"] = pd.array([w for _, _, w in titles], dtype="Int64")
            codes = each(frame["code"], lambda c: digit_bits(code_digits(c), (5, 6)))
            for i in (0, 1):
                out[f"c{i}"] = pd.array([None if c is None else c[i] for c in codes], dtype="Int64")
            out["amount"] = frame["amount"].where(frame["amount"] >= 1)
            groups = each(frame["cpv"], lambda c: digit_bits(re.sub(r"\D", "", (c or "").split("-")[0])[:3], (3,)))
            out["cpv"] = pd.array([None if g is None else g[0] for g in groups], dtype="Int64")
            out["day"] = pd.array(each(frame["date"], day), dtype="Int32")
            yield out

    found = records.select("id", "title", "code", "amount", "cpv", "date").mapInPandas(run, _SCHEMA)
    return found.withColumn("amount", F.nanvl("amount", F.lit(None)))


def _dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two 64-bit vectors; null if both are empty."""
    both = F.bit_count(a) + F.bit_count(b)
    return F.when(both > 0, 2 * F.bit_count(a.bitwiseAND(b)) / both)


def _bits(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(c) for c in columns])


def _both(parts: list[str]) -> list[Column]:
    """The bits that both records of a pair have."""
    return [F.col(f"{p}_a").bitwiseAND(F.col(f"{p}_b")) for p in parts]


def _of(parts: list[str], side: str) -> list[Column]:
    return [F.col(f"{p}_{side}") for p in parts]


def _dice_parts(parts: list[str]) -> Column:
    """The Dice similarity of vectors in several parts; null where one is unknown."""
    return 2 * _bits(_both(parts)) / (_bits(_of(parts, "a")) + _bits(_of(parts, "b")))


def _inside(parts: list[str]) -> Column:
    """The share of the smaller vector's bits that the larger has."""
    return F.try_divide(_bits(_both(parts)), F.least(_bits(_of(parts, "a")), _bits(_of(parts, "b"))))


def _level(value: Column, bounds: list[float]) -> Column:
    """How many of the bounds a value reaches; -1 where it is unknown."""
    out = F.lit(0)
    for x in bounds:
        out = out + F.when(value >= x, 1).otherwise(0)
    return F.when(value.isNull(), -1).otherwise(out)


#: The highest probability that a pair's similarities can give.
_SUREST = 0.9999
#: The fields' similarity levels: from the highest on they agree.
BOUNDS = {"title": [0.6, 0.75, 0.88, 0.97], "numbers": [0.3, 0.7, 0.999], "code": [0.8, 0.999], "amount": [0.98, 0.995, 0.9990], "cpv": [0.3, 0.6], "day": [0.5]}


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs of encoded records (columns ending in _a and _b) with the similarity of each field.

    Days agree up to one, as one of them may be of another zone.
    """
    both = F.col("t0_a").isNotNull() & F.col("t0_b").isNotNull()
    # a title without numbers that lies within the other names a kind of thing, not a lot: it says nothing
    bare = ((F.col("numbers_a") == 0) != (F.col("numbers_b") == 0)) & (_inside(TITLE) >= 0.95)
    title = F.when(both & ~bare, _dice_parts(TITLE))
    numbers = F.when(both & (F.col("numbers_a") != 0) & (F.col("numbers_b") != 0), _dice(F.col("numbers_a"), F.col("numbers_b")))
    near = F.least("amount_a", "amount_b") / F.greatest("amount_a", "amount_b")
    amount = F.when(F.col("amount_a").isNotNull() & F.col("amount_b").isNotNull(), near)
    cpv = _dice(F.col("cpv_a"), F.col("cpv_b"))
    when = F.when(F.col("day_a").isNotNull() & F.col("day_b").isNotNull(), F.when(F.abs(F.col("day_a") - F.col("day_b")) <= 1, 1.0).otherwise(0.0))
    found = {"title": title, "numbers": numbers, "code": _dice_parts(CODE), "amount": amount, "cpv": cpv, "day": when}
    return pairs.select("id_a", "id_b", *[v.cast("double").alias(k) for k, v in found.items()])


#: The fields that agree in the pairs of each kind of bucket, in the order of :func:`buckets`.
MET = [("code", "amount", "cpv"), ("amount", "day", "cpv"), ("amount", "day", "code"), ("amount", "title"), ("code", "title"), ("title", "numbers"), ("day", "title")]
#: The part of a kind's fields outside its bucket that is taken from all kinds together: a rare kind says little by itself.
_POOLED = 0.05


def calibrate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], dict[str, list[float]]]:
    """The match probability of each level pattern, and each field's weight by level.

    Classes of independent fields, fitted by EM to the patterns' counts; unknown levels (-1) say
    nothing. One class holds the matches. Pairs alike by chance have one for each kind of bucket
    (``MET``): they were met because its fields agree, and the others don't follow from that. In a single
    class the fields of all buckets would seem to agree by chance, each by itself, and to say little, the
    less the more pairs there are by chance: their number grows with the square of the records.
    It starts from matches told by the sum of the levels, and kinds by their fields' levels.
    """
    fields = list(BOUNDS)
    sizes = [len(BOUNDS[f]) + 1 for f in fields]
    x = np.array([p for p, _ in patterns], dtype=int).reshape(-1, len(fields))
    n = np.array([c for _, c in patterns], dtype=float)
    share = np.where(x >= 0, x / (np.array(sizes) - 1), np.nan)
    known = (x >= 0).sum(axis=1)
    score = np.where(known > 0, np.nansum(share, axis=1) / np.maximum(known, 1), 0.0)
    match = np.where((score > 0.85) & (known >= 3), 0.95, 0.02)
    agreed = np.where(x >= 0, share, 0.05)
    chance = np.stack([agreed[:, [fields.index(f) for f in kind]].prod(axis=1) for kind in MET], axis=1) + 1e-3
    member = np.column_stack([match, (1 - match)[:, None] * chance / chance.sum(axis=1, keepdims=True)])
    tables: list[np.ndarray] = []
    prior = np.full(member.shape[1], 1 / member.shape[1])
    for _ in range(rounds):
        weight = n[:, None] * member
        prior = np.maximum(weight.sum(axis=0), 1e-6)
        prior /= prior.sum()
        logs = np.tile(np.log(prior), (len(x), 1))
        tables = []
        for f, size in enumerate(sizes):
            table = np.stack([weight[x[:, f] == level].sum(axis=0) for level in range(size)])
            outside = [k + 1 for k, kind in enumerate(MET) if fields[f] not in kind]
            pooled = table[:, outside].sum(axis=1, keepdims=True)
            table[:, outside] += _POOLED / (1 - _POOLED) * pooled / max(pooled.sum(), 1e-9) * table[:, outside].sum(axis=0)
            table += 0.5
            tables.append(table / table.sum(axis=0))
            logs += np.where((x[:, f] >= 0)[:, None], np.log(tables[-1])[np.maximum(x[:, f], 0)], 0.0)
        member = np.exp(logs - logs.max(axis=1, keepdims=True))
        member /= member.sum(axis=1, keepdims=True)
    weights = {f: np.log(t[:, 0] / (t[:, 1:] @ prior[1:] / prior[1:].sum())).tolist() for f, t in zip(fields, tables, strict=True)}
    return {tuple(p): float(c) for p, c in zip(x.tolist(), member[:, 0], strict=True)}, weights


def match(left: DataFrame, right: DataFrame, least: float = 0.7) -> DataFrame:
    """(id_a, id_b, confidence): pairs of records of the two tables that match, in no order.

    A pair matches if its own similarities make it ``least`` likely. Its confidence also counts what
    else its records might match: of rivals that are as likely each gets its part.

    Both tables have id, title, code, amount, cpv and date; any attribute may be null, and a record
    too poor to lie in any bucket matches nothing. Repeated rows match as often as they occur.
    Extra columns are not used.
    """
    a, b = encode(left).checkpoint(), encode(right).checkpoint()
    ka = a.select(F.col("id").alias("id_a"), F.explode(buckets(around=True)).alias("key"))
    kb = b.select(F.col("id").alias("id_b"), F.explode(buckets(around=False)).alias("key"))
    met = ka.join(kb, "key").select("id_a", "id_b").distinct()
    fields = [*TITLE, "numbers", *CODE, "amount", "cpv", "day"]
    pairs = met.join(a.select(F.col("id").alias("id_a"), *[F.col(f).alias(f"{f}_a") for f in fields]), "id_a").join(
        b.select(F.col("id").alias("id_b"), *[F.col(f).alias(f"{f}_b") for f in fields]), "id_b"
    )
    levels = compare(pairs).select("id_a", "id_b", *[_level(F.col(f), bounds).alias(f) for f, bounds in BOUNDS.items()]).checkpoint()
    counted = levels.groupBy(*BOUNDS).agg(F.count("*").alias("n")).collect()  # a few thousand patterns at most
    confidence, _ = calibrate([(tuple(r[:-1]), r[-1]) for r in counted])
    spark = left.sparkSession
    rows = [(*p, min(c, _SUREST) / (1 - min(c, _SUREST))) for p, c in confidence.items() if c >= least]
    table = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in BOUNDS) + ", odds double")
    found = levels.join(F.broadcast(table), list(BOUNDS)).select("id_a", "id_b", "odds").distinct().checkpoint()
    # a record describes one thing: what a pair claims is shared with its rivals, of which equal ones count once
    said = F.xxhash64(*fields)
    told = found.join(a.select(F.col("id").alias("id_a"), said.alias("said_a")).distinct(), "id_a").join(b.select(F.col("id").alias("id_b"), said.alias("said_b")).distinct(), "id_b")
    claims = lambda own, other: told.groupBy(own, other).agg(F.max("odds").alias("odds")).groupBy(own).agg(F.sum("odds").alias(f"of_{own}"))
    whole = found.join(claims("id_a", "said_b"), "id_a").join(claims("id_b", "said_a"), "id_b")
    return whole.select("id_a", "id_b", (F.col("odds") / (1 + F.greatest("of_id_a", "of_id_b"))).alias("confidence"))
