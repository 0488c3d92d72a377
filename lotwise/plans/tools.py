"""The eight requests a user makes, over tables: each gives data frames and, rendered, text."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lotwise.functions import textmatch
from lotwise.operators import contracts, notice_xml
from lotwise.operators import search as selection
from lotwise.operators.search import QueryError, clamp
from lotwise.plans import documents, scan


def search_tenders(notices: DataFrame, filters: selection.Filters, page: int = 1, limit: int = 20, scope: str = "ALL", as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one page, how many match) of the notices of a scope."""
    return selection.search(selection.in_scope(notices, scope, as_of), filters, page, limit)


def get_tender(notices: DataFrame, number: str) -> DataFrame:
    """The notice of a number; an error without one."""
    if not number.strip():
        raise QueryError("a publication number is needed")
    found = notices.filter(F.col("publication_number") == number.strip())
    if found.isEmpty():
        raise QueryError(f"no notice has the number {number.strip()!r}")
    return found


def get_tender_document(notice_files: DataFrame, number: str, form: str = "xml", language: str = "", most: int = 60_000) -> DataFrame:
    """(publication_number, form, language, url, text, truncated, note) of one form of a notice.

    xml is of all languages, the others English unless said; of pdf only the address is given. The
    text is cut at ``most`` bytes, never within a character.
    """
    if not number.strip():
        raise QueryError("a publication number is needed")
    if form not in ("xml", "pdf", "html"):
        raise QueryError(f"unknown form {form!r}")
    lang = "MUL" if form == "xml" else (language.strip().upper() or "ENG")
    n = clamp(most, 60_000, 1 << 30)
    data = F.col("data") if form != "pdf" else F.lit(None).cast("binary")
    rows = notice_files.filter((F.col("publication_number") == number.strip()) & (F.col("form") == form) & (F.col("language") == lang))

    @F.pandas_udf("string")
    def whole(values: pd.Series) -> pd.Series:
        return values.map(lambda d: bytes(d).decode("utf-8", "ignore"), na_action="ignore")

    notes = {"html": "a page for people; the xml form has all fields", "pdf": "only the address is given", "xml": None}
    return rows.select("publication_number", "form", "language", "url", whole(F.substring(data, 1, n)).alias("text"), (F.octet_length("data") > n).alias("truncated"), F.lit(notes[form]).cast("string").alias("note"))


def get_tender_dossier(notice_xmls: DataFrame, numbers: list[str]) -> DataFrame:
    """Organisations, lots and links of notices; unreadable ones have a failure."""
    return notice_xml.shred(selection.get_many(notice_xmls, numbers), "publication_number", "xml", "dossier")


#: Roles of links that lead to documents.
DOCUMENT_ROLES = (notice_xml.TENDER_DOCUMENTS, notice_xml.SUBMISSION, notice_xml.BUYER_PROFILE, "requested")


def targets(links: DataFrame, all_roles: bool = False, urls: list[str] | None = None) -> DataFrame:
    """What to request: a caller's own addresses (of tender "requested", or 0), else the notices' links."""
    own = list(dict.fromkeys(u.strip() for u in urls or [] if u.strip()))
    if urls and not own:
        raise QueryError("none of the addresses says anything")
    if own:
        kind = dict(links.dtypes)["tender"]
        rows = [("requested" if kind == "string" else 0, u, "requested", i) for i, u in enumerate(own, 1)]
        return links.sparkSession.createDataFrame(rows, f"tender {kind}, url string, role string, seq bigint")
    return links if all_roles else links.filter(F.col("role").isin(*DOCUMENT_ROLES))


def fetch_tender_documents(
    links: DataFrame, fetched: DataFrame, all_roles: bool = False, files: int = 25, each: int = 20_000, total: int = 150_000, urls: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Documents of tenders' links or of a caller's own addresses; without ``all_roles`` only of roles that lead to documents."""
    return documents.gather(targets(links, all_roles, urls), fetched, clamp(files, 25, 60), each=each, total=total)


def scan_tender_documents(links: DataFrame, fetched: DataFrame, languages: DataFrame, matcher, all_roles: bool = False, urls: list[str] | None = None) -> dict[str, DataFrame]:
    """What was searched and found, by name: matches, tenders (counts and note), and the files in parts.

    inventory has the files that were read, unreadable those that came but could not be, refused the
    addresses and capped files that did not come; none of them carries text.
    """
    found, left = fetch_tender_documents(links, fetched, all_roles, 60, 500_000, 500_000, urls)
    matches, tenders = documents.search(found, languages, matcher)
    return {"matches": matches, "tenders": tenders, **documents.partition(found, left)}


def lookup_contracts(records: DataFrame, buyers: list[str], cpv: list[str] | None = None, value: float | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Contract records with counts and a note on why there are none."""
    found, stats = contracts.lookup(records, buyers, cpv, value, clamp(limit, 50, 50))
    note = F.when((F.col("matched") == 0) & (F.col("candidates") > 0), "the buyer is there, but no record of it fits").when(F.col("candidates") == 0, "the buyer is not in the snapshot")
    return found, stats.withColumn("note", note)


def scan_tenders(notice_xmls: DataFrame, matcher, most: int = scan.MATCHES, include_unmatched: bool = True, include_criteria: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, one row a notice, languages not searched) of notices (publication_number, xml).

    Notices without a match are left out unless ``include_unmatched``; those that could not be read
    are always rows, with a failure. ``include_criteria`` adds the criteria themselves.
    """
    key = "publication_number"
    content = notice_xml.shred(notice_xmls, key, "xml", "content")
    grid = content.select(key, F.posexplode("criteria").alias("seq", "c"))
    criteria = grid.select(key, "seq", F.col("c.lang").alias("lang"), F.trim(F.concat_ws(" ", "c.name", "c.description")).alias("text"))
    described = content.select(key, F.col("language").alias("lang"), F.posexplode("descriptions").alias("seq", "text")).select(key, F.lit(2).alias("tier"), "seq", "lang", "text")
    texts = content.select(key, F.posexplode("texts").alias("seq", "t")).select(key, F.lit(3).alias("tier"), "seq", F.col("t.lang").alias("lang"), F.col("t.text").alias("text"))
    # whole criteria are searched and cover other texts; only what is shown is cut
    matches = scan.notices(criteria, described.unionByName(texts), matcher, key, most).withColumn("snippet", F.when(F.col("tier") == 1, textmatch.truncate(F.col("snippet"), scan.CRITERION)).otherwise(F.col("snippet")))
    hits = matches.groupBy(key).agg(F.count("*").alias("matches"))
    grids = ["criteria"] if include_criteria else []
    notices = content.select(key, "language", (F.size("criteria") > 0).alias("criteria_published"), "failure", *grids).join(hits, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    if not include_unmatched:
        notices = notices.filter("matches > 0 or failure is not null")
    return matches, notices, scan.uncovered(content.filter("failure is null"), matcher, "language")


def first_non_empty(*values: str | None) -> str:
    return next((v.strip() for v in values if v and v.strip()), "")


def render(title: str, rows: Iterable[Row], fields: list[str], note: str | None = None) -> str:
    """Rows as text: a heading, a numbered line a row with its fields that aren't empty, and a note."""
    lines = [title]
    for i, row in enumerate(rows, 1):
        parts = [f"{f}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for f in fields if (v := row[f]) not in (None, "", [])]
        lines.append(f"{i}. " + "; ".join(parts))
    if len(lines) == 1:
        lines.append("(none)")
    return "\n".join([*lines, *([note] if note else [])])
