"""A tender's documents: links, pages, files found on them, their text, and what was not read.

Retrieval is no part of it: ``fetched`` (url, code, content_type, filename, data, allowed, failed, and
perhaps disposition, from which missing file names are taken) holds what came back for each address.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import markup
from lotwise.operators import extract, web
from lotwise.plans import scan

#: Roles whose pages are looked through for files.
FOLLOWED = ("tender-documents", "buyer-profile", "requested")
#: What became of addresses that brought no file.
REFUSED = ("robots-denied", "captcha", "blocked", "error", "not-downloaded")


def _page_links(pages: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for tender, url, seq, data in zip(frame["tender"], frame["url"], frame["seq"], frame["data"], strict=True):
                found = markup.candidates(url, bytes(data or b"").decode("utf-8", "replace"), most)
                rows += [(tender, u, label, seq * 10_000 + i) for i, (u, label) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["tender", "url", "label", "seq"])

    kind = dict(pages.dtypes)["tender"]
    return pages.select("tender", "url", "seq", "data").mapInPandas(run, f"tender {kind}, url string, label string, seq bigint")


def gather(links: DataFrame, fetched: DataFrame, files_most: int = 25, considered: int = 500, each: int = 20_000, total: int = 150_000, index: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """(documents, left out) of tenders' links (tender, url, role, seq).

    Documents have tender, seq, url, role, status, reason and the columns of an extracted file; texts
    are cut to ``each`` (pages that only list files to ``index``) and to ``total`` a tender. An
    address is taken once, found files by the rank of their address and label, no more than
    ``files_most`` a tender; the rest are counted. An address without an answer is not-downloaded.
    """
    status = web.fetch_status(F.col("code"), F.col("content_type"), F.col("data").cast("string"), F.coalesce("allowed", F.lit(True)), F.coalesce("failed", F.lit(False)))
    said = web.stated_name(F.col("disposition")) if "disposition" in fetched.columns else F.lit(None).cast("string")
    named = fetched.withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), said)).withColumn("fetch", status)
    why = web.fetch_reason(F.col("fetch"), F.col("code"), F.col("content_type"), F.col("data").cast("string"))
    answers = named.withColumn("why", why).dropDuplicates(["url"])
    first = Window.partitionBy("tender", "url").orderBy("seq")
    targets = links.filter(F.length(F.trim("url")) > 0).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    got = targets.join(answers, "url", "left")
    page = F.lower(F.coalesce("content_type", F.lit(""))).contains("html")
    pages = got.filter((F.col("fetch") == "fetched") & page & F.col("role").isin(*FOLLOWED))
    found = _page_links(pages, considered).filter(web.looks_like_document(F.col("url")))
    fresh = found.join(targets.select("tender", "url"), ["tender", "url"], "left_anti")
    once = fresh.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    rank = F.least(web.name_rank(F.col("url")), web.name_rank(F.col("label")))
    kept, left = web.ranked_cap(once, ["tender"], rank, "seq", files_most)
    files = kept.select("tender", "url", F.lit("tender-document").alias("role"), (F.lit(10**9) + F.col("place")).cast("bigint").alias("seq")).join(answers, "url", "left")
    columns = ["fetch", "why", "content_type", "filename", "data"]
    whole = got.select("tender", "url", "role", F.col("seq").cast("bigint").alias("seq"), *columns).unionByName(files.select("tender", "url", "role", "seq", *columns))
    ready = whole.filter("fetch = 'fetched'").withColumn("at", F.struct("tender", "url", "role", "seq"))
    name = F.coalesce(F.nullif("filename", F.lit("")), F.nullif(web.base_name(web.path(F.col("url"))), F.lit("")), F.col("url"))
    texts = extract.extract_files(ready.withColumn("name", name), "at").withColumnRenamed("seq", "part").select("at.*", "part", *[c.split()[0] for c in extract.SCHEMA.split(", ")])
    lists = F.col("role").isin(*FOLLOWED) & (F.col("kind") == "html")
    cut = texts.withColumn("text", F.when(lists, F.left("text", F.lit(index))).otherwise(F.col("text")))
    given = web.text_budget(cut.withColumnRenamed("truncated", "cut_by_limit"), ["tender"], ["seq", "part"], "text", each, total)
    read = given.select("tender", "seq", "part", "url", "role", "name", "kind", "status", "reason", "chars", F.col("given").alias("text"), (F.col("truncated") | F.col("cut_by_limit")).alias("truncated"), "withheld")
    answer = F.when(~F.coalesce(F.col("url").rlike(r"^(?i)https?://[^/\s]+"), F.lit(False)), "error").otherwise(F.coalesce("fetch", F.lit("not-downloaded")))
    refused = whole.filter("fetch is null or fetch <> 'fetched'").select(
        "tender", "seq", F.lit(0).alias("part"), "url", "role", F.col("filename").alias("name"), F.lit(None).cast("string").alias("kind"),
        answer.alias("status"), F.when(answer == "not-downloaded", "it was not requested").when((answer == "error") & F.col("why").isNull(), "the address is malformed").otherwise(F.col("why")).alias("reason"),
        F.lit(0).cast("bigint").alias("chars"), F.lit("").alias("text"), F.lit(False).alias("truncated"), F.lit(False).alias("withheld"),
    )
    return read.unionByName(refused), left


def partition(documents: DataFrame, left: DataFrame) -> dict[str, DataFrame]:
    """Gathered documents as inventory, unreadable and refused, without their texts.

    A tender's files that the cap left out are one refused row of it, with their number as reason.
    """
    bare = documents.drop("text")
    refused = F.col("status").isin(*REFUSED)
    capped = left.select("tender", F.lit("not-downloaded").alias("status"), F.concat(F.col("skipped").cast("string"), F.lit(" more files were left out by the limit")).alias("reason"))
    listing = F.col("role").isin(*FOLLOWED) & (F.col("kind") == "html")
    readable = (F.col("status") == "extracted") & (F.col("chars") > 0)
    return {
        "inventory": bare.filter(readable & ~listing),
        "unreadable": bare.filter(~refused & ~readable & ~F.coalesce(listing, F.lit(False))),
        "refused": bare.filter(refused).select("tender", "url", "status", "reason").unionByName(capped, allowMissingColumns=True),
    }


def search(documents: DataFrame, languages: DataFrame, matcher, most: int = scan.MATCHES) -> tuple[DataFrame, DataFrame]:
    """(matches, one row a tender of counts and a note) of gathered documents.

    ``languages`` (tender, lang) are the notices'. One match a readable file, pages that only list
    files left out, passages once, no more than ``most`` a tender.
    """
    rows = documents.join(languages, "tender", "left")
    readable = (F.col("status") == "extracted") & (F.col("chars") > 0)
    refused = F.col("status").isin(*REFUSED)
    listing = F.col("role").isin(*FOLLOWED) & (F.col("kind") == "html")
    found = scan.evidence(rows.filter(readable & ~listing), matcher, ["tender"], ["seq", "part", "url", "name"])
    from lotwise.functions.textmatch import passage_key

    fresh = scan.first_of_each(found, ["tender"], passage_key(F.col("snippet")), ["seq", "part"])
    matches = scan.top(fresh, ["tender"], ["seq", "part"], most).select("tender", "url", "name", "term", "snippet", "place")
    hits = matches.groupBy("tender").agg(F.count("*").alias("matches"))
    counts = rows.groupBy("tender").agg(
        F.count("*").alias("files"), F.count_if(readable).alias("readable"), F.count_if(refused).alias("refused"), F.count_if(~readable & ~refused).alias("unreadable"), F.count_if("withheld").alias("withheld")
    )
    note = (
        F.when(F.col("files") == F.col("refused"), "nothing was retrieved")
        .when(F.col("readable") == 0, "nothing that was retrieved could be read")
        .when(F.col("withheld") > 0, "some text was withheld by the limit")
        .when(F.col("matches") == 0, "no match is no proof of absence where files were refused or unreadable")
    )
    return matches, counts.join(hits, "tender", "left").withColumn("matches", F.coalesce("matches", F.lit(0))).withColumn("note", note)
