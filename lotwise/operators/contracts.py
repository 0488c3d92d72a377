"""Lookup of contract records by buyer, category and amount, with honest counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lenient(value: Column) -> Column:
    """A number written as text or number: 0 if blank, null if it is neither."""
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | text.isin("", "null"), F.lit(0.0)).otherwise(text.try_cast("double"))


def lookup(records: DataFrame, buyers: list[str], cpv: list[str] | None = None, value: float | None = None, limit: int = 50, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(records of the buyers, one row of counts).

    ``cpv``: prefixes of which one must fit; ``value``: the lot's or the whole tender's amount. The
    counts cover the whole table: scanned, candidates (of the buyers), malformed (of those) and
    matched; ``limit_hit`` says that more matched than are returned.
    """
    wanted = [b.strip() for b in buyers if b.strip()]
    if not wanted:
        raise ValueError("a buyer's code is needed")
    own = F.col("cf_amministrazione_appaltante").isin(wanted)
    lot, whole = lenient(F.col("importo_lotto")), lenient(F.col("importo_complessivo_gara"))
    bad = lot.isNull() | whole.isNull()
    fits = own & ~bad
    prefixes = [p.strip() for p in cpv or [] if p.strip()]
    if prefixes:
        fits = fits & reduce(lambda a, b: a | b, [F.col("cod_cpv").startswith(p) for p in prefixes])
    if value is not None:
        fits = fits & ((F.abs(lot - value) < tolerance) | (F.abs(whole - value) < tolerance))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    stats = records.agg(
        F.count("*").alias("scanned"), count(own).alias("candidates"), count(own & bad).alias("malformed"), count(fits).alias("matched")
    ).withColumn("limit_hit", F.col("matched") > limit)
    ties = [c for c in ("record_id",) if c in records.columns]  # repeated rows share their cig
    return records.filter(fits).orderBy("cig", *ties).limit(limit), stats


def join_values(notices: DataFrame, records: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Notices (buyer_code, value) with records of the same buyer and amount.

    An equi-join on the buyer and a step of the amount as wide as the tolerance, looked up in the
    neighbouring steps as well; so a buyer with many records is spread by their amounts. The exact
    band is a residual. A record is met by its lot's amount or, where that is another, by the whole's:
    each pair of rows once.
    """
    step = lambda v: F.floor(v / tolerance).cast("bigint")
    amounts = records.withColumn("__lot", lenient(F.col("importo_lotto"))).withColumn("__whole", lenient(F.col("importo_complessivo_gara")))
    spread = amounts.withColumn("__step", F.explode(F.array_distinct(F.array_compact(F.array(step(F.col("__lot")), step(F.col("__whole")))))))
    around = step(F.col("value"))
    asked = notices.withColumn("__at", F.explode(F.array_compact(F.array(around - 1, around, around + 1))))
    by_lot = F.coalesce(F.abs(F.col("__lot") - F.col("value")) < tolerance, F.lit(False))
    by_whole = F.abs(F.col("__whole") - F.col("value")) < tolerance
    near = (by_lot & (F.col("__step") == step(F.col("__lot")))) | (~by_lot & by_whole & (F.col("__step") == step(F.col("__whole"))))
    same = (F.col("buyer_code") == F.col("cf_amministrazione_appaltante")) & (F.col("__at") == F.col("__step"))
    return asked.join(spread, same & near).drop("__lot", "__whole", "__step", "__at")


# The fields of a record; the file writes one of them in capitals.
FIELDS = (
    "cig", "numero_gara", "oggetto_gara", "oggetto_lotto", "importo_lotto", "importo_complessivo_gara", "cod_cpv", "descrizione_cpv",
    "data_pubblicazione", "data_scadenza_offerta", "denominazione_amministrazione_appaltante", "cf_amministrazione_appaltante",
    "stato", "esito", "tipo_scelta_contraente", "n_lotti_componenti", "provincia",
)
_NUMBERS = ("importo_lotto", "importo_complessivo_gara", "n_lotti_componenti")


def parse_lines(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` with the record's fields, and ``problem`` where a line is no record or a number none.

    Keys count in any case, the last of equal ones; fields that are absent are empty text. ``extra``:
    further fields to read.
    """
    found = F.from_json("line", "map<string,string>")
    named = F.transform(F.map_entries("__record"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    value = lambda f: F.coalesce(F.element_at(F.concat(F.array(F.struct(F.lit(f).alias("key"), F.lit("").alias("value"))), F.filter("__named", lambda e: e["key"] == f)), -1)["value"], F.lit(""))
    parsed = lines.withColumn("__record", F.when(F.col("line").isNotNull() & (F.trim("line") != ""), found)).withColumn("__named", named)
    fields = [F.when(F.col("__record").isNotNull(), value(f)).alias(f) for f in (*FIELDS, *extra)]
    rows = parsed.select(*lines.columns, F.col("__record").isNotNull().alias("__read"), *fields)
    bad = reduce(lambda a, b: a | b, [lenient(F.col(f)).isNull() for f in _NUMBERS])
    problem = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("line").isNull() | (F.col("line") == ""), F.lit(None)).when(~F.col("__read"), "the line is no JSON object").when(bad, "a number is none")
    return rows.withColumn("problem", problem).drop("__read")


def lookup_archives(archives: DataFrame, buyers: list[str], cpv: list[str] | None = None, value: float | None = None, limit: int = 50, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(records, one row of counts) of ZIP archives (path, content) of newline-delimited records; see :func:`lookup_lines`."""
    from lotwise.sources.files import archive_lines

    return lookup_lines(archive_lines(archives, [b.strip() for b in buyers if b.strip()]), buyers, cpv, value, limit, tolerance)


def lookup_lines(lines: DataFrame, buyers: list[str], cpv: list[str] | None = None, value: float | None = None, limit: int = 50, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(records, one row of counts) of the lines of archives (path, member, place, line, lines, fault).

    A line is a candidate if it holds a buyer's code anywhere; only candidates are parsed. The counts
    cover all archives: scanned (blank lines as well), candidates, malformed of these with the first
    problem in order of path, member and line, and matched; ``limit_hit`` says that more matched than
    are returned.
    """
    wanted = [b.strip() for b in buyers if b.strip()]
    if not wanted:
        raise ValueError("a buyer's code is needed")
    rows = parse_lines(lines)
    named = reduce(lambda a, b: a | b, [F.col("line").contains(b) for b in wanted])
    candidate = (F.coalesce(F.col("line") != "", F.lit(False)) & named) | F.col("fault").isNotNull()
    lot, whole = lenient(F.col("importo_lotto")), lenient(F.col("importo_complessivo_gara"))
    fits = candidate & F.col("problem").isNull() & F.col("cf_amministrazione_appaltante").isin(wanted)
    prefixes = [p.strip() for p in cpv or [] if p.strip()]
    if prefixes:
        fits = fits & reduce(lambda a, b: a | b, [F.col("cod_cpv").startswith(p) for p in prefixes])
    if value is not None:
        fits = fits & ((F.abs(lot - value) < tolerance) | (F.abs(whole - value) < tolerance))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    wrong = candidate & F.col("problem").isNotNull()
    stats = rows.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("scanned"), count(candidate).alias("candidates"), count(wrong).alias("malformed"), count(fits).alias("matched"),
        F.min(F.when(wrong, F.struct("path", "member", "place", "problem")))["problem"].alias("first_problem"),
    ).withColumn("limit_hit", F.col("matched") > limit)
    return rows.filter(fits).orderBy("cig", "path", "member", "place").limit(limit).select(*FIELDS), stats


def asked_by(dossiers: DataFrame, key: str = "publication_number", values: DataFrame | None = None) -> DataFrame:
    """(key, buyer_code, value) by which the contracts of shredded notices are looked up.

    The buyer is the first organisation of that role; notices whose buyer has no code are left out.
    ``values`` (key, total_value) gives the amounts, lenient numbers; without it they are null.
    """
    buyer = F.get(F.filter("organizations", lambda o: F.array_contains(o["roles"], "buyer")), F.lit(0))
    keys = dossiers.select(key, F.nullif(F.trim(buyer["company_id"]), F.lit("")).alias("buyer_code")).filter(F.col("buyer_code").isNotNull())
    if values is None:
        return keys.withColumn("value", F.lit(None).cast("double"))
    amounts = values.groupBy(key).agg(F.min("total_value").alias("__v"))
    return keys.join(amounts, key, "left").withColumn("value", F.when(F.trim("__v") != "", lenient(F.col("__v")))).drop("__v")
