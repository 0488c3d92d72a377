"""Results as text for people and as JSON for programs, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.textmatch import strip, truncate


def first_non_empty(*values: Column) -> Column:
    """The first value that isn't blank, as it is written; empty text without one."""
    filled = lambda v: F.when(strip(v) != "", v)
    return F.coalesce(*map(filled, values), F.lit(""))


def join_non_empty(mark: str, *values: Column) -> Column:
    """The values that aren't blank, with a mark between them."""
    return F.concat_ws(mark, *[F.when(strip(v) != "", v) for v in values])


def _line(label: str, value: Column, before: str = "\n   ") -> Column:
    """A labelled value on a line of its own; nothing for an empty one."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{before}{label}: "), value)).otherwise("")


def notice_lines() -> Column:
    """A notice of a list: its title, and below it a line for each part that it has."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(
        first_non_empty(F.col("title"), F.lit("(untitled)")),
        F.lit("\n   publication: "), col("publication_number"), _line("type", col("notice_type"), "  "),
        _line("buyer", join_non_empty(" / ", col("buyer_name"), col("buyer_country"))),
        _line("cpv", F.array_join(F.coalesce("cpv", F.array()), ", ")),
        _line("published", F.left(col("publication_date"), F.lit(10))), _line("deadline", col("deadline"), "  "),
        _line("value", col("total_value")), _line("link", col("ted_url")),
    )


def contract_lines() -> Column:
    """A contract record of a list."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(
        F.lit("cig "), first_non_empty(F.col("cig"), F.lit("-")), _line("tender", col("numero_gara"), "  "),
        _line("subject", first_non_empty(F.col("oggetto_lotto"), F.col("oggetto_gara"))),
        _line("amount", join_non_empty(" of ", col("importo_lotto"), col("importo_complessivo_gara"))),
        _line("cpv", join_non_empty(" ", col("cod_cpv"), col("descrizione_cpv"))),
        _line("published", col("data_pubblicazione")), _line("deadline", col("data_scadenza_offerta"), "  "),
        _line("buyer", join_non_empty(" / ", col("denominazione_amministrazione_appaltante"), col("cf_amministrazione_appaltante"))),
        _line("state", join_non_empty(" / ", col("stato"), col("esito"))),
    )


def file_lines() -> Column:
    """An extracted file of a list: what it is, how long, and why it says nothing."""
    return F.concat(
        first_non_empty(F.col("name"), F.lit("(unnamed)")), F.when(F.col("container") != "", F.concat(F.lit(" in "), "container")).otherwise(""),
        F.lit(" ["), F.col("kind"), F.lit(", "), F.col("status"), F.lit("]"),
        F.when(F.col("chars") > 0, F.concat(F.lit("  "), F.col("chars").cast("string"), F.lit(" characters"))).otherwise(""),
        F.when(F.col("truncated"), F.lit(", cut")).otherwise(""), _line("note", F.col("reason")),
    )


def match_line(where: Column, weight: Column, text: Column) -> Column:
    """A passage that was found: the part of the notice it is in, what it weighs there, and the passage."""
    return F.concat(F.lit("match ["), join_non_empty(", weight ", where, weight), F.lit("]: "), text)


def criterion_line(weight: Column, text: Column, most: int = 160) -> Column:
    """A criterion in a list: its weight in brackets, and the beginning of its text."""
    return F.concat(F.lit("["), first_non_empty(weight, F.lit("-")), F.lit("] "), truncate(text, most))


def language_list(uncovered: DataFrame) -> DataFrame:
    """(text): languages that were not searched with the texts of each, in order; one row."""
    each = F.concat("language", F.lit(" ("), F.col("texts").cast("string"), F.lit(")"))
    return uncovered.agg(F.array_join(F.array_sort(F.collect_list(each)), ", ").alias("text"))  # a language a row


def envelope(records: DataFrame, stats: DataFrame, order: list[str]) -> DataFrame:
    """(json): one text of the records, in order, and the one row of counts beside them.

    For the bounded answers of requests; a table is written with ``write.json``.
    """
    found = records.agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in records.columns if c not in order]))).alias("records"))
    both = found.unionByName(stats, allowMissingColumns=True)  # two rows, folded into one
    whole = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("records", *stats.columns)])
    return whole.select(F.to_json(F.struct("records", *stats.columns), {"ignoreNullFields": "false"}).alias("json"))
