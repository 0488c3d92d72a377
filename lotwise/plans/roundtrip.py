"""Queries over documents that are made of the test tables and read again, each with the SQL that says the same.

Notice XML, pages, office files, archives, envelopes, PDF, robots.txt files and snapshots are written
from the columns of the tables and go through the operators that real ones would go through. The SQL
takes the plain columns, so a row is right only if nothing was lost or added on the way.
"""

from __future__ import annotations

import base64
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import multilingual as L
from lotwise.functions import textmatch as M
from lotwise.operators import access, contracts, extract, notice_xml, web
from lotwise.operators import search as S
from lotwise.plans import documents, rendering, scan, tools
from lotwise.plans.tender_queries import _SPACE, NEAR_A, NEAR_B, TERMS, _sql_by_language, _sql_hit, _sql_strip
from lotwise.sources.tables import read

MARKED = "R&D <3"
BUYERS, CODES = ["01935680007", "84311390003"], ["4523", "3414"]


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def tag(name: str, *content: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(c) if isinstance(c, str) else c for c in content], F.lit(f"</{name}>"))


def each(items: Column, make) -> Column:
    return F.array_join(F.transform(F.coalesce(items, F.array()), make), "")


def page(lines: Column, inside: str = "p") -> Column:
    """A page of a block a line, with what no reader sees and a constant line of signs."""
    head = "<html><head><title>hidden</title><style>p{color:red}</style></head><body><!-- a > b --><script>if (a<b) {hide()}</script>"
    return F.concat(F.lit(head), each(lines, lambda x: tag(inside, escaped(x))), F.lit("<div>R&amp;D &lt;3</div></body></html>"))


def notice(row: DataFrame) -> Column:
    """The XML of a dossier; the buyer is the first organisation of that role."""
    buyer = F.get(F.filter(F.coalesce("organizations", F.array()), lambda o: F.array_contains(o["roles"], "buyer")), F.lit(0))["id"]
    organization = lambda o: tag(
        "Organization",
        tag(
            "Company",
            tag("PartyIdentification", tag("ID", escaped(o["id"]))), tag("PartyName", tag("Name", escaped(o["name"]))),
            tag("PartyLegalEntity", tag("CompanyID", escaped(o["company_id"]))), tag("Contact", tag("ElectronicMail", escaped(o["email"]))),
            tag("PostalAddress", tag("CityName", escaped(o["city"])), tag("Country", tag("IdentificationCode", escaped(o["country"])))),
        ),
    )
    criterion = lambda c: tag(
        "SubordinateAwardingCriterion",
        '<cbc:UBLExtensions><x:UBLExtension><ExtensionContent><EformsExtension><AwardCriterionParameter><ParameterCode listName="number-weight">w</ParameterCode>',
        tag("ParameterNumeric", escaped(c["weight"])), "</AwardCriterionParameter></EformsExtension></ExtensionContent></x:UBLExtension></cbc:UBLExtensions>",
        tag("AwardingCriterionTypeCode", escaped(c["type"])), tag("Name", escaped(c["name"])), F.lit('<Description languageID="ita">'), escaped(c["description"]), "</Description>",
    )
    lot = lambda x: tag(
        "ProcurementProjectLot",
        tag("ID", escaped(x["id"])),
        tag(
            "ProcurementProject", tag("Name", escaped(x["title"])), F.lit('<RequestedTenderTotal><EstimatedOverallContractAmount currencyID="'), escaped(x["currency"]), '">', escaped(x["value"]),
            "</EstimatedOverallContractAmount></RequestedTenderTotal>", each(F.slice(x["cpv"], 1, 1), lambda c: tag("MainCommodityClassification", tag("ItemClassificationCode", escaped(c)))),
            each(F.slice(x["cpv"], F.lit(2), F.greatest(F.size(x["cpv"]), F.lit(1))), lambda c: tag("AdditionalCommodityClassification", tag("ItemClassificationCode", escaped(c)))),
        ),
        tag("TenderingProcess", tag("TenderSubmissionDeadlinePeriod", tag("EndDate", escaped(x["deadline_date"])), tag("EndTime", escaped(x["deadline_time"])))),
        # AwardingTerms is never closed: readers must be lenient
        tag("TenderingTerms", tag("CallForTendersDocumentReference", tag("Attachment", tag("ExternalReference", tag("URI", escaped(x["documents_url"]))))),
            tag("TenderRecipientParty", tag("EndpointID", escaped(x["submission_url"]))), "<AwardingTerms>", tag("AwardingCriterion", each(x["criteria"], criterion))),
    )
    return tag(
        "Notice",
        tag("ContractFolderID", escaped(F.col("internal_id"))),
        tag("TenderingProcess", tag("ProcedureCode", escaped(F.col("procedure_type"))), tag("TenderSubmissionDeadlinePeriod", tag("EndDate", escaped(F.col("deadline_date"))), tag("EndTime", escaped(F.col("deadline_time"))))),
        "<NoticeLanguageCode>ita</NoticeLanguageCode><UBLExtensions><UBLExtension><ExtensionContent><EformsExtension>",
        tag("Organizations", each(F.col("organizations"), organization)),
        "</EformsExtension></ExtensionContent></UBLExtension></UBLExtensions>",
        tag("ContractingParty", tag("Party", tag("PartyIdentification", tag("ID", escaped(buyer))))),
        each(F.col("lots"), lot),
    )


def _xml(spark: SparkSession, folder: str, cut: bool = False) -> DataFrame:
    """Notices as files; with ``cut`` those of dossiers without lots end too early."""
    rows = read(spark, folder, "dossiers")
    body = notice(rows)
    ends = F.left(body, F.length(body) - 9) if cut else body
    return rows.select("dossier_id", F.when(F.size(F.coalesce("lots", F.array())) == 0, ends).otherwise(body).alias("xml"))


def xml_organizations(spark: SparkSession, folder: str) -> DataFrame:
    found = notice_xml.shred(_xml(spark, folder), "dossier_id", "xml", "dossier").select("dossier_id", F.explode("organizations").alias("o"))
    return found.select("dossier_id", *[F.col(f"o.{c}").alias(c) for c in ("id", "name", "company_id", "email", "city", "country")], F.array_join("o.roles", ",").alias("roles"))


def xml_lots(spark: SparkSession, folder: str) -> DataFrame:
    found = notice_xml.shred(_xml(spark, folder), "dossier_id", "xml", "dossier").select("dossier_id", F.posexplode("lots").alias("pos", "x"))
    plain = ("id", "title", "value", "currency", "deadline_date", "deadline_time", "documents_url", "submission_url")
    return found.select("dossier_id", F.col("pos").cast("bigint").alias("pos"), *[F.col(f"x.{c}").alias(c) for c in plain], F.array_join("x.cpv", ",").alias("cpv"), F.size("x.criteria").cast("bigint").alias("criteria"))


def xml_criteria(spark: SparkSession, folder: str) -> DataFrame:
    """Each criterion of a notice once, as scans see it."""
    found = notice_xml.shred(_xml(spark, folder), "dossier_id", "xml", "content").select("dossier_id", F.explode("criteria").alias("c"))
    return found.select("dossier_id", *[F.col(f"c.{c}").alias(c) for c in ("type", "name", "description", "weight", "lang")])


def xml_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each address of a notice once, with the first role it has."""
    found = notice_xml.shred(_xml(spark, folder), "dossier_id", "xml", "dossier").select("dossier_id", F.posexplode("links").alias("pos", "k"))
    return found.select("dossier_id", F.col("pos").cast("bigint").alias("pos"), F.col("k.url").alias("url"), F.col("k.role").alias("role"))


def xml_failures(spark: SparkSession, folder: str) -> DataFrame:
    found = notice_xml.shred(_xml(spark, folder, cut=True), "dossier_id", "xml", "content")
    return found.select("dossier_id", F.col("failure").isNotNull().alias("failed"), F.coalesce(F.size("criteria") > 0, F.lit(False)).alias("criteria_published"))


def buyer_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """How many contracts the buyer of each notice has: the key is taken from its XML."""
    asked = contracts.asked_by(notice_xml.shred(_xml(spark, folder), "dossier_id", "xml", "dossier"), "dossier_id")
    counts = read(spark, folder, "contracts").groupBy(F.col("cf_amministrazione_appaltante").alias("buyer_code")).agg(F.count("*").alias("found"))
    return asked.join(counts, "buyer_code", "left").select("dossier_id", "buyer_code", F.coalesce("found", F.lit(0)).alias("found"))


# --- pages and files ------------------------------------------------------------------------


def _lines() -> Column:
    return F.split(F.col("text"), "\n")


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as pages, and read as their readers see them."""
    rows = read(spark, folder, "documents", spread=True).filter(F.col("text").isNotNull())
    pages = rows.select("doc_id", F.lit("page").alias("name"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode(page(_lines()), "UTF-8").alias("data"))
    return extract.extract_files(pages, "doc_id").select("doc_id", "kind", "status", "text", "chars")


def _packed(kind: str, text: str) -> bytes:
    """A text in a file of a kind."""
    if kind == "p7m":
        der = lambda t, body: bytes([t, 0x84]) + len(body).to_bytes(4, "big") + body
        oid = lambda n: bytes.fromhex(f"06092a864886f70d01070{n}")
        inner = der(0x30, oid(1) + der(0xA0, der(0x04, text.encode())))
        return base64.encodebytes(der(0x30, oid(2) + der(0xA0, der(0x30, inner))))
    signs = lambda line: line.replace("&", "&amp;").replace("<", "&lt;")
    if kind == "xml":
        inside = "\n".join(f"<a:p>{signs(line)}</a:p>" for line in text.split("\n"))
        return f"<?xml version='1.0'?><a:d xmlns:a='u'><!-- a > b -->{inside}</a:d>".encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if kind == "docx":
            lines = "".join(f"<w:p><w:r><w:t>{signs(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
            z.writestr("word/document.xml", f"<w:document><w:body>{lines}</w:body></w:document>")
            z.writestr("docProps/app.xml", "<x>hidden</x>")
        else:
            z.writestr("__MACOSX/atto.txt", "hidden")
            z.writestr("atti/.DS_Store", "hidden")
            z.writestr("atti/atto.txt", text)
    return out.getvalue()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document in a file of one of six kinds, by its id; null texts are files without bytes."""

    @F.pandas_udf("binary")
    def data(ids: pd.Series, texts: pd.Series, pages: pd.Series) -> pd.Series:
        def one(i: int, text: str | None, html: str) -> bytes | None:
            if text is None:
                return None
            kind = KINDS[i % len(KINDS)]
            return {"txt": text, "html": html}[kind].encode() if kind in ("txt", "html") else _packed(kind, text)

        return pd.Series([one(*r) for r in zip(ids, texts, pages, strict=True)], dtype=object)

    rows = read(spark, folder, "documents", spread=True)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    name = F.concat(F.lit("atto."), F.when(kind == "p7m", "txt.p7m").otherwise(kind))
    return rows.select("doc_id", name.alias("name"), F.lit("").alias("content_type"), data("doc_id", "text", page(F.coalesce(_lines(), F.array()))).alias("data"))


KINDS = ("txt", "html", "xml", "docx", "zip", "p7m")


def extracted_files(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.extract_files(_files(spark, folder), "doc_id")
    return found.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "name", "container", "kind", "status", "chars", (F.col("reason") == "").alias("no_reason"))


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """The members of archives, in the order in which their names are sought."""
    return extract.extract_files(_archives(spark, folder), "doc_id").select("doc_id", F.col("seq").cast("bigint").alias("seq"), "name", "container", "kind", "chars")


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of four members, of which one is an archive."""

    @F.pandas_udf("binary")
    def data(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("contratto.txt", "deep " + text[:20])
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in (("allegato.txt", text), ("nota.txt", "note"), ("sub/", ""), ("sub/disciplinare.txt", text + "!"), ("altri.zip", inner.getvalue())):
                    z.writestr(name, body)
            return out.getvalue()

        return texts.map(one)

    rows = read(spark, folder, "documents", spread=True).filter(F.length(F.trim("text")) > 0)
    return rows.select("doc_id", F.lit("gara.zip").alias("name"), F.lit("application/zip").alias("content_type"), data("text").alias("data"))


def pdf_text(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts as one-page PDF files of up to three lines."""

    @F.pandas_udf("binary")
    def data(lines: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            shown = " 0 -14 Td ".join("({}) Tj".format(x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")) for x in text.split("\n") if x)
            stream = f"BT /F1 12 Tf 72 700 Td {shown} ET".encode("cp1252", "replace")
            return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length 9>> stream\n" + stream + b"\nendstream endobj\n%%EOF"

        return lines.map(one)

    lines = F.array_join(F.filter(F.array("cig", "cod_cpv", "stato"), lambda x: F.length(x) > 0), "\n")
    files = read(spark, folder, "contracts", spread=True).select("record_id", F.lit("x.pdf").alias("name"), F.lit("").alias("content_type"), data(lines).alias("data"))
    return extract.extract_files(files, "record_id").select("record_id", "kind", "status", F.col("pages").cast("bigint").alias("pages"), "text")


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of a page a tender that may be followed on its own site, the first label of each."""
    lots = read(spark, folder, "lots").filter(F.col("documents_url").isNotNull())
    link = lambda url, label: F.concat(F.lit('<li><A class=x HREF="'), escaped(url), F.lit('#top">'), tag("b", escaped(label)), F.lit("</A><a href='mailto:x@y.example'>mail</a>"))
    rows = lots.groupBy("publication_number").agg(F.min("documents_url").alias("url"), F.sort_array(F.collect_list(F.struct("lot_row", "title", "documents_url", "submission_url"))).alias("lots"))
    html = each(F.col("lots"), lambda x: F.concat(link(x["documents_url"], x["title"]), F.when(x["submission_url"].isNotNull(), link(x["submission_url"], F.lit("submit"))).otherwise("")))
    pages = rows.select(F.col("publication_number").alias("tender"), "url", F.lit(1).alias("seq"), F.encode(html, "UTF-8").alias("data"))
    return documents._page_links(pages, 500).select(F.col("tender").alias("publication_number"), "url", "label")


# --- requests -------------------------------------------------------------------------------


def _answers(url: Column) -> dict[str, Column]:
    """What a request for an address would bring, by its length."""
    n = F.length(url) % 5
    code = F.when(n == 1, 404).when(n == 2, 503).when(n == 3, None).otherwise(200)
    body = F.when(n == 4, F.lit("<html><div class='g-recaptcha'></div></html>")).otherwise(F.concat(F.lit("about "), url))
    return {"code": code.cast("int"), "failed": n == 3, "body": body}


def _robots(hosts: DataFrame) -> DataFrame:
    """Robots.txt files of hosts: a third each has rules, none published, or did not answer."""
    third = F.regexp_extract("host", r"(\d)[^\d]*$", 1).cast("int") % 3
    text = "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: third\n\nDisallow: /procedure/*5\nAllow: /procedure/*55\nDisallow:\nCrawl-delay: 3\nDisallow: /*submit$ # no forms"
    return hosts.select("host", F.when(third == 1, 404).otherwise(200).alias("code"), F.lit(text).alias("body"), (third == 2).alias("failed"))


def _addresses(spark: SparkSession, folder: str) -> DataFrame:
    lots = read(spark, folder, "lots")
    return lots.select(F.explode(F.array("documents_url", "submission_url")).alias("url")).filter(F.col("url").isNotNull()).distinct()


def robots_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Which addresses a reader without a group of its own may request."""
    urls = _addresses(spark, folder)
    hosts = urls.select(web.host(F.col("url")).alias("host")).distinct()
    return access.decide(urls, _robots(hosts), "reader/1.0")


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    lots = read(spark, folder, "lots").filter(F.col("documents_url").isNotNull())
    url = F.when(F.col("lot_row") % 3 == 0, F.concat("documents_url", F.lit("?id=7&x=y#top"))).otherwise(F.col("documents_url"))
    said = F.when(F.col("lot_row") % 2 == 0, F.concat(F.lit('attachment; filename="'), F.col("lot_id"), F.lit('.pdf"')))
    return lots.select("lot_row", web.request_path(url).alias("request"), web.file_name(said, url).alias("file"))


def fetch_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the request for each address, robots.txt files before answers."""
    urls = _addresses(spark, folder)
    allowed = access.decide(urls, _robots(urls.select(web.host(F.col("url")).alias("host")).distinct()), "reader/1.0")
    a = _answers(F.col("url"))
    status = web.fetch_status(a["code"], F.lit("text/html"), a["body"], F.col("allowed") | F.col("failed"), a["failed"] | F.col("failed"))
    found = allowed.select("url", status.alias("status"))
    return found.withColumn("reason", web.fetch_reason(F.col("status"), a["code"], F.lit("text/html"), a["body"]))


def _requests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Tenders' links, and what came back for them."""
    lots = read(spark, folder, "lots")
    links = lots.select(F.col("publication_number").alias("tender"), F.posexplode(F.array("documents_url", "submission_url")).alias("k", "url"), "lot_row").filter(F.col("url").isNotNull())
    links = links.select("tender", "url", F.when(F.col("k") == 0, "tender-documents").otherwise("submission-endpoint").alias("role"), (F.col("lot_row") * 2 + F.col("k")).alias("seq"))
    a = _answers(F.col("url"))
    fetched = _addresses(spark, folder).select(
        "url", a["code"].alias("code"), F.when(F.length("url") % 5 == 4, "text/html").otherwise("text/plain").alias("content_type"), F.lit(None).cast("string").alias("filename"),
        F.encode(a["body"], "UTF-8").alias("data"), F.lit(True).alias("allowed"), a["failed"].alias("failed"),
    )
    return links, fetched


def gathered(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of tenders' links: each address once, its text, or why there is none."""
    found, _ = tools.fetch_tender_documents(*_requests(spark, folder), each=40, total=90)
    return found.select(F.col("tender").alias("publication_number"), "url", "role", "status", "chars", F.length("text").cast("bigint").alias("given"), "withheld")


def tender_partition(spark: SparkSession, folder: str) -> DataFrame:
    """By tender: documents read, refused and unreadable, those withheld, matches, and the note on it."""
    rows = read(spark, folder, "documents", spread=True).filter(F.col("publication_number").isNotNull())
    n = F.length("text") % 7
    status = F.when(F.col("text").isNull(), "damaged").when(n == 3, "blocked").when(n == 4, "encrypted").otherwise("extracted")
    docs = rows.select(
        F.col("publication_number").alias("tender"), F.col("doc_id").alias("seq"), F.lit(0).alias("part"), F.lit("u").alias("url"), F.lit("tender-document").alias("role"), F.col("kind").alias("name"),
        F.lit("text").alias("kind"), status.alias("status"), F.length("text").cast("bigint").alias("chars"), "text", (n == 5).alias("withheld"),
    )
    languages = rows.groupBy(F.col("publication_number").alias("tender")).agg(F.max(F.upper("lang")).alias("lang"))
    _, counts = documents.search(docs, languages, M.matcher(TERMS))
    return counts.select(F.col("tender").alias("publication_number"), "files", "readable", "refused", "unreadable", "withheld", "matches", "note")


def tender_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The files of tenders' links in parts: read, refused and unreadable, counted by tender."""
    links, fetched = _requests(spark, folder)
    languages = links.select("tender", F.lit("ITA").alias("lang")).distinct()
    parts = tools.scan_tender_documents(links, fetched, languages, M.matcher({"ITA": ["procedure/"]}))
    rows = [parts[p].select(F.col("tender").alias("publication_number"), F.lit(p).alias("part"), "status") for p in ("inventory", "unreadable", "refused")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("publication_number", "part", "status").agg(F.count("*").alias("files"))


# --- requests of one tender -----------------------------------------------------------------


def tender_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of the latest notices of a country."""
    rows = read(spark, folder, "notices").select("publication_number", "loaded_at", "notice_row", "publication_date", "buyer_country", "title")
    page, _ = tools.search_tenders(rows, S.Filters(country=["ita"], order="asc"), page=2, limit=15, scope="latest")
    return page.select("publication_number", "notice_row", "title")


def tender(spark: SparkSession, folder: str) -> DataFrame:
    """The notice of the least number."""
    rows = read(spark, folder, "notices")
    number = rows.agg(F.min("publication_number")).first()[0]
    return tools.get_tender(rows, number).select("publication_number", "notice_row", "title")


def tender_dossiers(spark: SparkSession, folder: str) -> DataFrame:
    """The procedures of the notices numbered 0 to 399."""
    xml = _xml(spark, folder).withColumn("publication_number", F.col("dossier_id").cast("string"))
    found = tools.get_tender_dossier(xml, [str(i) for i in range(400)])
    return found.select(F.col("publication_number").cast("bigint").alias("dossier_id"), "internal_id", "procedure_type", "deadline_date", "deadline_time")


def lookup_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Why a lookup found nothing."""
    records = read(spark, folder, "contracts")
    asked = {"fits": ([BUYERS[0]], None), "other": ([BUYERS[0]], ["00"]), "absent": (["no code"], None)}
    rows = [tools.lookup_contracts(records, *a)[1].select(F.lit(k).alias("asked"), F.coalesce("note", F.lit("")).alias("note")) for k, a in asked.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- snapshots and selection ----------------------------------------------------------------


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts as ZIP archives of newline-delimited JSON, 4,000 records each in two members, keys in changing case."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for half, rows in group.sort_values("record_id").groupby(group["record_id"] % 2):
                z.writestr(f"part/{half}.json", "\n".join(rows["line"]))
            z.writestr("readme/", "")
        return pd.DataFrame({"path": [f"{int(group['pack'].iloc[0])}.zip"], "content": [out.getvalue()]})

    rows = read(spark, folder, "contracts")
    fields = [c for c in contracts.FIELDS if c in rows.columns]
    named = lambda change: F.to_json(F.struct(*[F.col(c).alias(change(c)) for c in fields], F.col("record_id").cast("string").alias("numero")))
    line = F.when(F.col("record_id") % 3 == 0, named(str.upper)).otherwise(named(str))
    return rows.select("record_id", F.floor(F.col("record_id") / 4000).alias("pack"), line.alias("line")).groupBy("pack").applyInPandas(pack, "path string, content binary")


def snapshot_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = contracts.lookup_archives(_snapshot(spark, folder), BUYERS, CODES, limit=10**6)
    return found.select("cig", "cod_cpv", "importo_lotto", "oggetto_gara", "esito")


def snapshot_stats(spark: SparkSession, folder: str) -> DataFrame:
    _, stats = contracts.lookup_archives(_snapshot(spark, folder), BUYERS, CODES, limit=50)
    return stats.withColumn("first_problem", F.col("first_problem").isNotNull())


def notice_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Notices as captured search responses of fields by language, and summed up again."""
    rows = read(spark, folder, "notices")
    by_language = lambda c: F.struct(F.lit("autre").alias("fra"), F.array(F.col(c)).alias("eng"))
    forms = {"xml": F.struct(F.col("xml_url").alias("MUL")), "pdf": F.struct(F.lit("").alias("FRA"), F.col("pdf_url").alias("DEU")), "html": F.struct(F.col("ted_url").alias("ENG"))}
    links = F.struct(*[v.alias(k) for k, v in forms.items()])
    body = F.to_json(
        F.struct(
            F.col("notice_row").cast("string").alias("publication-number"), by_language("title").alias("notice-title"), F.col("notice_type").alias("notice-type"), by_language("buyer_name").alias("buyer-name"),
            F.array("buyer_country").alias("buyer-country"), F.col("publication_date").alias("publication-date"), F.col("cpv").alias("classification-cpv"), F.col("place_of_performance").alias("place-of-performance"), links.alias("links"),
        )
    )
    bodies = rows.groupBy(F.floor(F.col("notice_row") / 50)).agg(F.concat(F.lit('{"notices": ['), F.array_join(F.collect_list(body), ","), F.lit("]}")).alias("body"))
    found = L.summaries(bodies)
    text = lambda c: F.coalesce(c, F.lit(""))
    return found.select(
        F.col("publication_number").cast("bigint").alias("notice_row"), *[text(c).alias(c) for c in ("title", "notice_type", "buyer_name", "buyer_country", "publication_date", "xml_url", "pdf_url", "html_url")],
        F.array_join("cpv", ",").alias("cpv"), F.array_join("place_of_performance", ",").alias("places"),
    )


def _written_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as notices whose deadlines are written in five formats."""
    at, kind = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T10:00:00+01:00")))
        .when(kind == 1, F.concat(F.date_format(at, "dd/MM/yyyy"), F.lit(" 10:00")))
        .when(kind == 2, F.date_format(at, "yyyyMMdd"))
        .when(kind == 3, F.concat(F.date_format(at, "dd.MM.yyyy"), F.lit(" 23:59 (Europe/Rome)")))
        .otherwise(F.date_format(at, "d MMMM yyyy"))
    )
    return read(spark, folder, "orders", spread=True).select("o_orderkey", text.alias("deadline"))


def search_deadline(spark: SparkSession, folder: str) -> DataFrame:
    filters = S.Filters(deadline_from="1995-03-01", deadline_to="1996/02/29")
    return _written_orders(spark, folder).filter(S.compile_filters(filters)[1]).select("o_orderkey")


def search_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of a parent category or its children."""
    _, predicate = S.compile_filters(S.Filters(cpv=["45000000", "33140000-3"]), hierarchy=True)
    return read(spark, folder, "notices").filter(predicate).select("notice_row", "publication_number")


def cache_use(spark: SparkSession, folder: str) -> DataFrame:
    """Of the addresses asked for, how many are held already."""
    lots = read(spark, folder, "lots")
    asked = lots.filter(F.col("documents_url").isNotNull()).select(F.col("documents_url").alias("key"))
    held = lots.filter((F.col("lot_row") % 2 == 0) & F.col("documents_url").isNotNull()).select(F.col("documents_url").alias("key"))
    return web.cache_use(asked, held, "key")


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The lookup's answer as one JSON text with its records and counts."""
    found, stats = contracts.lookup(read(spark, folder, "contracts"), BUYERS, CODES, limit=50)
    return rendering.envelope(found.select("cig", "cod_cpv", "importo_lotto"), stats, order=["cig", "cod_cpv", "importo_lotto"])


def rendered_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Notices as people read them in a list."""
    return read(spark, folder, "notices").select("notice_row", rendering.notice_lines().alias("text"))


def rendered_contracts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "contracts").select("record_id", rendering.contract_lines().alias("text"))


def rendered_criteria(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "award_criteria", spread=True)
    both = M.collapse(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    return rows.select("crit_row", rendering.criterion_line(F.col("weight"), both).alias("line"), rendering.match_line(F.lit("award criterion"), F.col("weight"), F.coalesce("name", F.lit(""))).alias("match"))


def rendered_files(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.extract_files(_files(spark, folder), "doc_id", limits=extract.Limits(chars=900))
    return found.filter("status = 'extracted'").select("doc_id", rendering.file_lines().alias("text"))


def archive_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of which only two members are read, and 50 characters of each; what is left out is one row."""
    files = _archives(spark, folder)
    found = extract.extract_files(files, "doc_id", limits=extract.Limits(members=2, chars=50))
    return found.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "name", "status", "chars", F.length("text").cast("bigint").alias("given"), "truncated")


def office_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sheets, slides and texts of office programs, by their id."""

    @F.pandas_udf("binary")
    def data(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(i: int, text: str) -> bytes:
            rows = [x.replace("&", "&amp;").replace("<", "&lt;") for x in text.split("\n")]
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                if i % 3 == 0:
                    z.writestr("xl/workbook.xml", "<hidden>x</hidden>")
                    z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{x}</t></si>" for x in rows) + "</sst>")
                elif i % 3 == 1:  # parts are read in order of their names
                    z.writestr("ppt/slides/slide2.xml", "<p:sld><a:p><a:t>second</a:t></a:p></p:sld>")
                    z.writestr("ppt/presentation.xml", "<hidden>x</hidden>")
                    z.writestr("ppt/slides/slide1.xml", "<p:sld>" + "".join(f"<a:p><a:t>{x}</a:t></a:p>" for x in rows) + "</p:sld>")
                else:
                    z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
                    z.writestr("styles.xml", "<hidden>x</hidden>")
                    z.writestr("content.xml", "<office:text>" + "".join(f"<text:p>{x}</text:p>" for x in rows) + "</office:text>")
            return out.getvalue()

        return pd.Series([one(*r) for r in zip(ids, texts, strict=True)], dtype=object)

    rows = read(spark, folder, "documents", spread=True).filter(F.col("text").isNotNull())
    files = rows.select("doc_id", F.lit("file.bin").alias("name"), F.lit("").alias("content_type"), data("doc_id", "text").alias("data"))
    return extract.extract_files(files, "doc_id").select("doc_id", "kind", "status", "text")


def human_references(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "contracts")
    return rows.select("record_id", notice_xml.human_reference(F.col("numero_gara")).alias("tender"), notice_xml.human_reference(F.col("oggetto_gara")).alias("subject"))


def matcher_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    made = {"terms": M.matcher(TERMS), "pairs": M.matcher(near={"a": NEAR_A, "b": NEAR_B, "window": 40}), "both": M.matcher({"it": [" x ", ""]}, ["y"], {"a": {"": ["z"]}}), "regex": M.matcher(regex="a+")}
    return spark.createDataFrame([(k, m.describe()) for k, m in made.items()], "name string, description string")


def scan_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row a notice scanned: whether its criteria are published, what matched, in which language."""
    xml = _xml(spark, folder, cut=True).withColumnRenamed("dossier_id", "publication_number")
    _, notices, _ = tools.scan_tenders(xml, M.matcher({"ITA": TERMS["IT"]}), include_unmatched=True)
    return notices.select(F.col("publication_number").alias("dossier_id"), "criteria_published", (F.col("matches") > 0).alias("matched"), F.col("failure").isNotNull().alias("failed"))


def tender_files(spark: SparkSession, folder: str) -> DataFrame:
    """One form of a tender's files, as text of so many bytes."""
    rows = read(spark, folder, "documents").filter(F.col("text").isNotNull()).withColumn("form", F.lit("xml")).withColumn("language", F.lit("MUL")).withColumn("url", F.concat(F.lit("https://x.example/"), "doc_id"))
    files = rows.select(F.lit("1-2025").alias("publication_number"), "form", "language", "url", F.encode(F.replace("text", F.lit("à"), F.lit("a")), "UTF-8").alias("data"))
    return tools.get_tender_document(files, " 1-2025 ", most=300).select("url", "truncated", (F.octet_length("text") <= 300).alias("fits"))


def search_scope(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each notice."""
    rows = read(spark, folder, "notices").select("publication_number", "loaded_at", "notice_row", "title")
    return S.in_scope(rows, "latest").select("publication_number", "notice_row")


def uncovered_text(spark: SparkSession, folder: str) -> DataFrame:
    """The languages that English terms leave unsearched, as one text."""
    return rendering.language_list(scan.uncovered(read(spark, folder, "documents"), M.matcher({"EN": ["street"]})))


def queries() -> dict:
    own = [
        xml_organizations, xml_lots, xml_criteria, xml_links, xml_failures, buyer_contracts, html_text, extracted_files, archive_members, pdf_text, page_links,
        robots_decisions, url_parts, fetch_statuses, gathered, tender_partition, snapshot_lookup, snapshot_stats, notice_responses, search_deadline, search_hierarchy,
        cache_use, envelopes, rendered_notices, human_references, matcher_descriptions, scan_report, tender_files, search_scope, uncovered_text,
        rendered_contracts, rendered_criteria, rendered_files, archive_limits, office_files, tender_parts, tender_page, tender, tender_dossiers, lookup_notes,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    clean = lambda x: _sql_strip(f"regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g')")
    flat = lambda x: f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    lines = lambda x: f"""array_to_string(list_filter(list_transform(string_split({flat(x)}, chr(10)), lambda y: {_sql_strip(f"regexp_replace(y, '{_SPACE}', ' ', 'g')")}), lambda y: y <> ''), chr(10))"""
    plain = lambda x: _sql_strip(rf"regexp_replace({flat(x)}, '\n{{3,}}', chr(10) || chr(10), 'g')")
    organizations = "(SELECT dossier_id, o.*, k FROM (SELECT dossier_id, unnest(organizations) AS o, generate_subscripts(organizations, 1) AS k FROM dossiers) WHERE o IS NOT NULL)"
    lots = "(SELECT dossier_id, x, k FROM (SELECT dossier_id, unnest(lots) AS x, generate_subscripts(lots, 1) AS k FROM dossiers))"
    buyer = "list_filter(coalesce(organizations, []), lambda o: list_contains(o.roles, 'buyer'))[1].id"
    named = f"SELECT q.*, {clean('q.id')} AS i, {clean('b.buyer')} AS b, row_number() OVER (PARTITION BY q.dossier_id, {clean('q.id')} ORDER BY k DESC) AS last FROM {organizations} q JOIN (SELECT dossier_id, {buyer} AS buyer FROM dossiers) b USING (dossier_id)"
    criteria = f"(SELECT dossier_id, c.* FROM (SELECT dossier_id, unnest(x.criteria) AS c FROM {lots}) WHERE c IS NOT NULL)"
    kept = f"list_filter(lots, lambda x: len(list_filter(coalesce(x.criteria, []), lambda c: {clean('c.name')} || {clean('c.description')} <> '')) > 0)"
    size = "length(url) % 5"
    edge = r"^[…\s\x{85}\p{Z}]+"
    host = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    site = lambda u: rf"CASE WHEN len(string_split({u}, '.')) > 3 THEN array_to_string(string_split({u}, '.')[-3:], '.') ELSE {u} END"
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    urls = "(SELECT DISTINCT url FROM (SELECT documents_url AS url FROM lots UNION ALL SELECT submission_url FROM lots) WHERE url IS NOT NULL)"
    third = rf"(CAST(regexp_extract({host}, '(\d)[^\d]*$', 1) AS INT) % 3)"
    barred = f"(CASE WHEN regexp_matches({path}, '^/procedure/.*55') THEN false WHEN regexp_matches({path}, '^/procedure/.*5') THEN true ELSE regexp_matches({path}, '^/[^s]*submit$') END)"
    decided = f"(SELECT url, CASE {third} WHEN 0 THEN NOT {barred} WHEN 1 THEN true ELSE false END AS allowed, {third} = 2 AS failed FROM {urls})"
    start, _ = _sql_by_language(M.Spec(TERMS), lambda n: _sql_hit(M._of(M.Spec(TERMS).terms, n)))
    low = "replace(lower(replace(text, 'İ', 'I')), 'ς', 'σ')"
    number = lambda c: f"CASE WHEN {c} IS NULL OR trim({c}) IN ('', 'null') THEN 0.0 ELSE TRY_CAST(trim({c}) AS DOUBLE) END"
    numbers = [number(c) for c in ("importo_lotto", "importo_complessivo_gara", "n_lotti_componenti")]
    held = " OR ".join("contains(concat_ws(' ', " + ", ".join(contracts.FIELDS) + f", record_id::VARCHAR), '{b}')" for b in BUYERS)
    fine = " AND ".join(f"({n}) IS NOT NULL" for n in numbers)
    fits = f"cf_amministrazione_appaltante IN {tuple(BUYERS)} AND {fine} AND (" + " OR ".join(f"starts_with(cod_cpv, '{c}')" for c in CODES) + ")"
    asked = "cf_amministrazione_appaltante IN ('01935680007', '84311390003') AND (starts_with(cod_cpv, '4523') OR starts_with(cod_cpv, '3414')) AND (" + numbers[0] + ") IS NOT NULL AND (" + numbers[1] + ") IS NOT NULL"
    own = "cf_amministrazione_appaltante IN ('01935680007', '84311390003')"
    line = lambda label, x, before=r"chr(10) || '   '": f"CASE WHEN coalesce({x}, '') <> '' THEN {before} || '{label}: ' || {x} ELSE '' END"
    found = f"(SELECT d.publication_number, doc_id, text, length(text) % 7 AS n, l, {start} AS start FROM (SELECT *, upper(trim(coalesce(lang2, ''))) AS l, {low} AS low FROM (SELECT d.*, m.lang2 FROM documents d JOIN (SELECT publication_number, max(upper(lang)) AS lang2 FROM documents GROUP BY 1) m USING (publication_number))) d)"
    status = "CASE WHEN text IS NULL THEN 'damaged' WHEN n = 3 THEN 'blocked' WHEN n = 4 THEN 'encrypted' ELSE 'extracted' END"
    filled = lambda mark, *cs: f"concat_ws('{mark}', " + ", ".join(f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN {c} END" for c in cs) + ")"
    out = {
        "xml_organizations": f"SELECT dossier_id, {', '.join(f'{clean(c)} AS {c}' for c in ('id', 'name', 'company_id', 'email', 'city', 'country'))}, CASE WHEN i = b AND b <> '' AND last = 1 THEN 'buyer' ELSE '' END AS roles FROM ({named}) WHERE i <> '' OR {clean('name')} <> ''",
        "xml_lots": f"""SELECT dossier_id, (k - 1)::BIGINT AS pos, {', '.join(f"{clean(f'x.{c}')} AS {c}" for c in ('id', 'title', 'value', 'documents_url', 'submission_url'))}, coalesce(x.currency, '') AS currency,
            left({clean('x.deadline_date')}, 10) AS deadline_date, left({clean('x.deadline_time')}, 5) AS deadline_time,
            array_to_string(list_filter(list_transform(coalesce(x.cpv, []), lambda c: {clean('c')}), lambda c, i: c <> '' AND list_position(list_transform(x.cpv, lambda c2: {clean('c2')}), c) = i), ',') AS cpv,
            len(list_distinct(list_filter(list_transform(coalesce(x.criteria, []), lambda c: concat_ws('|', {clean('c.type')}, {clean('c.name')}, {clean('c.description')}, {clean('c.weight')})), lambda t: split_part(t, '|', 2) || split_part(t, '|', 3) <> '')))::BIGINT AS criteria FROM {lots}""",
        "xml_criteria": f"SELECT DISTINCT dossier_id, {clean('type')} AS type, {clean('name')} AS name, {clean('description')} AS description, {clean('weight')} AS weight, 'ITA' AS lang FROM {criteria} WHERE {clean('name')} <> '' OR {clean('description')} <> ''",
        "xml_links": f"""SELECT dossier_id, row_number() OVER (PARTITION BY dossier_id ORDER BY first) - 1 AS pos, url, CASE first % 2 WHEN 0 THEN 'tender-documents' ELSE 'submission-endpoint' END AS role FROM (
            SELECT dossier_id, url, min(n) AS first FROM (SELECT dossier_id, k * 2 AS n, {clean('x.documents_url')} AS url FROM {lots} UNION ALL SELECT dossier_id, k * 2 + 1, {clean('x.submission_url')} FROM {lots}) WHERE starts_with(url, 'http') GROUP BY 1, 2)""",
        "xml_failures": f"SELECT dossier_id, len(coalesce(lots, [])) = 0 AS failed, len(coalesce({kept}, [])) > 0 AS criteria_published FROM dossiers",
        "buyer_contracts": f"""SELECT dossier_id, buyer_code, coalesce(found, 0) AS found FROM (SELECT dossier_id, {clean('company_id')} AS buyer_code, row_number() OVER (PARTITION BY dossier_id ORDER BY k) AS n FROM ({named}) WHERE i = b AND b <> '' AND last = 1) a
            LEFT JOIN (SELECT cf_amministrazione_appaltante AS code, count(*) AS found FROM contracts GROUP BY 1) c ON c.code = buyer_code WHERE n = 1 AND buyer_code <> ''""",
        "html_text": f"SELECT doc_id, 'html' AS kind, 'extracted' AS status, t AS text, length(t) AS chars FROM (SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END || '{MARKED}' AS t FROM (SELECT doc_id, {lines('text')} AS t FROM documents WHERE text IS NOT NULL))",
        "extracted_files": f"""SELECT doc_id, 0::BIGINT AS seq, CASE k WHEN 5 THEN CASE WHEN text IS NULL THEN 'atto.txt.p7m' ELSE 'atto.txt' END WHEN 4 THEN CASE WHEN text IS NULL THEN 'atto.zip' ELSE 'atti/atto.txt' END ELSE 'atto.' || {list(KINDS)}[k + 1] END AS name,
            CASE WHEN text IS NULL THEN '' WHEN k = 5 THEN 'atto.txt.p7m' WHEN k = 4 THEN 'atto.zip' ELSE '' END AS container,
            CASE WHEN nothing THEN 'unknown' WHEN k IN (0, 4, 5) THEN 'text' ELSE {list(KINDS)}[k + 1] END AS kind, CASE WHEN nothing THEN 'damaged' ELSE 'extracted' END AS status,
            CASE WHEN nothing THEN 0 WHEN k = 1 THEN length(CASE WHEN t = '' THEN '' ELSE t || chr(10) END || '{MARKED}') WHEN k IN (2, 3) THEN length(t) ELSE length({plain('text')}) END AS chars,
            NOT nothing AND (k = 1 OR (k IN (2, 3) AND t <> '') OR (k IN (0, 4, 5) AND {plain('text')} <> '')) AS no_reason
            FROM (SELECT doc_id, doc_id % 6 AS k, text, {lines("coalesce(text, '')")} AS t, text IS NULL OR (text = '' AND doc_id % 6 IN (0, 4, 5)) AS nothing FROM documents)""",
        "archive_members": f"""SELECT doc_id, m.seq::BIGINT AS seq, m.name AS name, 'gara.zip' AS container, 'text' AS kind, CASE m.seq WHEN 0 THEN length({plain("text || '!'")}) WHEN 1 THEN length({plain('text')}) WHEN 2 THEN 4 ELSE length({plain("'deep ' || left(text, 20)")}) END AS chars
            FROM documents, (VALUES (0, 'sub/disciplinare.txt'), (1, 'allegato.txt'), (2, 'nota.txt'), (3, 'contratto.txt')) m(seq, name) WHERE length(trim(text)) > 0""",
        "pdf_text": """SELECT record_id, 'pdf' AS kind, CASE WHEN t = '' THEN 'no-text-layer' ELSE 'extracted' END AS status, 1::BIGINT AS pages, t AS text
            FROM (SELECT record_id, array_to_string(list_filter([cig, cod_cpv, stato], lambda x: length(x) > 0), chr(10)) AS t FROM contracts)""",
        "page_links": f"""SELECT publication_number, url, arg_min(label, n) AS label FROM (SELECT l.publication_number, l.url, l.label, l.n, h, {host.replace('url', 'l.url')} AS there FROM (
            SELECT publication_number, documents_url AS url, {clean('title')} AS label, lot_row * 2 AS n FROM lots WHERE documents_url IS NOT NULL UNION ALL SELECT publication_number, submission_url, 'submit', lot_row * 2 + 1 FROM lots WHERE documents_url IS NOT NULL AND submission_url IS NOT NULL) l
            JOIN (SELECT publication_number, {host.replace('url', 'u')} AS h FROM (SELECT publication_number, min(documents_url) AS u FROM lots GROUP BY 1)) p USING (publication_number)) WHERE h = there OR ({site('h')}) = ({site('there')}) GROUP BY 1, 2""",
        "robots_decisions": f"SELECT url, allowed, failed FROM {decided}",
        "url_parts": """SELECT lot_row, regexp_extract(documents_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || CASE WHEN lot_row % 3 = 0 THEN '?id=7&x=y' ELSE '' END AS request,
            CASE WHEN lot_row % 2 = 0 AND lot_id IS NOT NULL THEN lot_id || '.pdf' ELSE nullif(regexp_extract(documents_url, '/([^/?#]*)$', 1), '') END AS file FROM lots WHERE documents_url IS NOT NULL""",
        "fetch_statuses": f"""SELECT url, status, CASE status WHEN 'robots-denied' THEN 'robots.txt asks programs not to request it' WHEN 'error' THEN 'no answer came' WHEN 'blocked' THEN 'the answer was ' || CASE {size} WHEN 1 THEN '404' ELSE '503' END
            WHEN 'captcha' THEN 'a puzzle (reCAPTCHA) is shown in place of the content' END AS reason FROM (SELECT url, CASE WHEN NOT (allowed OR failed) THEN 'robots-denied' WHEN failed OR {size} = 3 THEN 'error' WHEN {size} IN (1, 2) THEN 'blocked' WHEN {size} = 4 THEN 'captcha' ELSE 'fetched' END AS status FROM {decided})""",
        "gathered": f"""SELECT publication_number, url, role, CASE WHEN {size} = 3 THEN 'error' WHEN {size} IN (1, 2) THEN 'blocked' WHEN {size} = 4 THEN 'captcha' ELSE 'extracted' END AS status, CASE WHEN {size} = 0 THEN 6 + length(url) ELSE 0 END AS chars,
            CASE WHEN {size} = 0 THEN greatest(least(least(6 + length(url), 40), 90 - spent), 0) ELSE 0 END AS given, {size} = 0 AND spent >= 90 AS withheld FROM (
            SELECT *, coalesce(sum(CASE WHEN {size} = 0 THEN least(6 + length(url), 40) ELSE 0 END) OVER (PARTITION BY publication_number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM (
            SELECT publication_number, url, arg_min(role, seq) AS role, min(seq) AS seq FROM (SELECT publication_number, documents_url AS url, 'tender-documents' AS role, lot_row * 2 AS seq FROM lots UNION ALL SELECT publication_number, submission_url, 'submission-endpoint', lot_row * 2 + 1 FROM lots) WHERE url IS NOT NULL GROUP BY 1, 2))""",
        "tender_partition": f"""SELECT publication_number, count(*) AS files, count(*) FILTER (s = 'extracted' AND length(text) > 0) AS readable, count(*) FILTER (s = 'blocked') AS refused, count(*) FILTER (s <> 'blocked' AND NOT coalesce(s = 'extracted' AND length(text) > 0, false)) AS unreadable,
            count(*) FILTER (n = 5) AS withheld, least(count(DISTINCT CASE WHEN s = 'extracted' AND start IS NOT NULL THEN key END), 12) AS matches,
            CASE WHEN count(*) = count(*) FILTER (s = 'blocked') THEN 'nothing was retrieved' WHEN count(*) FILTER (s = 'extracted' AND length(text) > 0) = 0 THEN 'nothing that was retrieved could be read' WHEN count(*) FILTER (n = 5) > 0 THEN 'some text was withheld by the limit'
            WHEN count(DISTINCT CASE WHEN s = 'extracted' AND start IS NOT NULL THEN key END) = 0 THEN 'no match is no proof of absence where files were refused or unreadable' END AS note
            FROM (SELECT *, {status} AS s, left(lower(regexp_replace(CASE WHEN start > 181 THEN '…' ELSE '' END || {_sql_strip("substr(text, greatest(start - 180, 1), 400)")}, '{edge}', '', 'g')), 80) AS key FROM {found}) GROUP BY 1""",
        "snapshot_lookup": f"SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in ('cig', 'cod_cpv', 'importo_lotto', 'oggetto_gara', 'esito'))} FROM contracts WHERE {fits}",
        "snapshot_stats": f"SELECT count(*) AS scanned, count(*) FILTER ({held}) AS candidates, count(*) FILTER (({held}) AND NOT ({fine})) AS malformed, count(*) FILTER ({fits}) AS matched, count(*) FILTER (({held}) AND NOT ({fine})) > 0 AS first_problem, count(*) FILTER ({fits}) > 50 AS limit_hit FROM contracts",
        "notice_responses": """SELECT notice_row, coalesce(title, '') AS title, coalesce(notice_type, '') AS notice_type, coalesce(buyer_name, '') AS buyer_name, coalesce(buyer_country, '') AS buyer_country, coalesce(left(publication_date, 10), '') AS publication_date,
            coalesce(xml_url, '') AS xml_url, coalesce(pdf_url, '') AS pdf_url, coalesce(nullif(ted_url, ''), 'https://journal.example/en/notice/-/detail/' || notice_row) AS html_url,
            array_to_string(list_filter(coalesce(cpv, []), lambda x, i: list_position(cpv, x) = i AND x <> ''), ',') AS cpv, array_to_string(list_filter(coalesce(place_of_performance, []), lambda x, i: list_position(place_of_performance, x) = i AND x <> ''), ',') AS places FROM notices""",
        "search_deadline": "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'",
        "search_hierarchy": "SELECT notice_row, publication_number FROM notices WHERE len(list_filter(cpv, lambda x: starts_with(x, '45') OR starts_with(x, '3314'))) > 0",
        "cache_use": "SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS misses FROM (SELECT documents_url IN (SELECT documents_url FROM lots WHERE lot_row % 2 = 0 AND documents_url IS NOT NULL) AS h FROM lots WHERE documents_url IS NOT NULL)",
        "envelopes": f"""SELECT '{{"records":[' || coalesce((SELECT string_agg('{{"cig":' || coalesce(to_json(cig)::VARCHAR, 'null') || ',"cod_cpv":' || coalesce(to_json(cod_cpv)::VARCHAR, 'null') || ',"importo_lotto":' || coalesce(to_json(importo_lotto)::VARCHAR, 'null') || '}}', ',' ORDER BY cig, cod_cpv, importo_lotto)
            FROM (SELECT * FROM contracts WHERE {asked} ORDER BY cig, record_id LIMIT 50)), '') || '],"scanned":' || count(*) || ',"candidates":' || count(*) FILTER ({own}) || ',"malformed":' || count(*) FILTER ({own} AND (({numbers[0]}) IS NULL OR ({numbers[1]}) IS NULL)) || ',"matched":' || count(*) FILTER ({asked}) || ',"limit_hit":' || (count(*) FILTER ({asked}) > 50) || '}}' AS json FROM contracts""",
        "rendered_notices": f"""SELECT notice_row, CASE WHEN trim(coalesce(title, '')) <> '' THEN title ELSE '(untitled)' END || chr(10) || '   publication: ' || coalesce(publication_number, '') || {line('type', 'notice_type', "'  '")}
            || {line('buyer', "concat_ws(' / ', CASE WHEN trim(coalesce(buyer_name, '')) <> '' THEN buyer_name END, CASE WHEN trim(coalesce(buyer_country, '')) <> '' THEN buyer_country END)")}
            || {line('cpv', "array_to_string(coalesce(cpv, []), ', ')")} || {line('published', 'left(publication_date, 10)')} || {line('deadline', 'deadline', "'  '")} || {line('value', 'total_value')} || {line('link', 'ted_url')} AS text FROM notices""",
        "human_references": "SELECT record_id, coalesce(numero_gara <> '' AND strlen(numero_gara) <= 40, false) AS tender, coalesce(oggetto_gara <> '' AND strlen(oggetto_gara) <= 40, false) AS subject FROM contracts",
        "matcher_descriptions": """SELECT * FROM (VALUES ('terms', '6 term(s) across 3 language(s)'), ('pairs', '3+4 paired root(s) within 40 chars across 2 language(s)'), ('both', '2 term(s), 1+0 paired root(s) within 60 chars across 2 language(s)'), ('regex', 'regular expression a+')) t(name, description)""",
        "scan_report": f"""SELECT dossier_id, criteria_published, matched, failed FROM (SELECT d.dossier_id, CASE WHEN len(coalesce(lots, [])) > 0 THEN len(coalesce({kept}, [])) > 0 END AS criteria_published, len(coalesce(lots, [])) = 0 AS failed,
            coalesce(hit, false) AS matched FROM dossiers d LEFT JOIN (SELECT dossier_id, bool_or(contains(t, 'lampioni') OR contains(t, 'gasolio')) AS hit FROM (
            SELECT dossier_id, lower({clean("name")} || ' ' || {clean("description")}) AS t FROM {criteria} UNION ALL SELECT dossier_id, lower({clean("x.title")}) FROM {lots} UNION ALL SELECT dossier_id, lower({clean("name")}) FROM {organizations} UNION ALL SELECT dossier_id, lower({clean("city")}) FROM {organizations}) GROUP BY 1) h USING (dossier_id))""",
        "tender_files": "SELECT 'https://x.example/' || doc_id AS url, strlen(replace(text, 'à', 'a')) > 300 AS truncated, true AS fits FROM documents WHERE text IS NOT NULL",
        "rendered_contracts": f"""SELECT record_id, 'cig ' || CASE WHEN trim(coalesce(cig, '')) <> '' THEN cig ELSE '-' END || {line('tender', 'numero_gara', "'  '")}
            || {line('subject', "CASE WHEN trim(coalesce(oggetto_lotto, '')) <> '' THEN oggetto_lotto WHEN trim(coalesce(oggetto_gara, '')) <> '' THEN oggetto_gara ELSE '' END")} || {line('amount', filled(' of ', 'importo_lotto', 'importo_complessivo_gara'))}
            || {line('cpv', filled(' ', 'cod_cpv', 'descrizione_cpv'))} || {line('published', 'data_pubblicazione')} || {line('deadline', 'data_scadenza_offerta', "'  '")}
            || {line('buyer', filled(' / ', 'denominazione_amministrazione_appaltante', 'cf_amministrazione_appaltante'))} || {line('state', filled(' / ', 'stato', 'esito'))} AS text FROM contracts""",
        "rendered_criteria": f"""SELECT crit_row, '[' || CASE WHEN trim(coalesce(weight, '')) <> '' THEN weight ELSE '-' END || '] ' || CASE WHEN length(t) > 160 THEN {_sql_strip('left(t, 160)')} || '…' ELSE t END AS line,
            'match [award criterion' || CASE WHEN trim(coalesce(weight, '')) <> '' THEN ', weight ' || weight ELSE '' END || ']: ' || coalesce(name, '') AS match
            FROM (SELECT *, {clean("(coalesce(name, '') || ' ' || coalesce(description, ''))")} AS t FROM award_criteria)""",
        "rendered_files": f"""SELECT doc_id, name || CASE WHEN container <> '' THEN ' in ' || container ELSE '' END || ' [' || kind || ', extracted]' || CASE WHEN chars > 0 THEN '  ' || chars || ' characters' ELSE '' END || CASE WHEN chars > 900 THEN ', cut' ELSE '' END
            || CASE WHEN chars = 0 THEN chr(10) || '   note: ' || CASE kind WHEN 'docx' THEN 'no text is in it, perhaps its pages are pictures' ELSE 'the document holds no text' END ELSE '' END AS text
            FROM (EXTRACTED) WHERE status = 'extracted'""",
        "archive_limits": f"""SELECT doc_id, m.seq::BIGINT AS seq, m.name AS name, CASE m.seq WHEN 2 THEN 'unsupported' ELSE 'extracted' END AS status, CASE m.seq WHEN 0 THEN length({plain("text || '!'")}) WHEN 1 THEN length({plain('text')}) ELSE 0 END AS chars,
            CASE m.seq WHEN 0 THEN least(length({plain("text || '!'")}), 50) WHEN 1 THEN least(length({plain('text')}), 50) ELSE 0 END AS given, CASE m.seq WHEN 0 THEN length({plain("text || '!'")}) > 50 WHEN 1 THEN length({plain('text')}) > 50 ELSE false END AS truncated
            FROM documents, (VALUES (0, 'sub/disciplinare.txt'), (1, 'allegato.txt'), (2, '2 more')) m(seq, name) WHERE length(trim(text)) > 0""",
        "office_files": f"""SELECT doc_id, ['xlsx', 'pptx', 'odf'][doc_id % 3 + 1] AS kind, 'extracted' AS status, CASE doc_id % 3 WHEN 1 THEN CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END || 'second' ELSE t END AS text FROM (SELECT doc_id, {lines('text')} AS t FROM documents WHERE text IS NOT NULL)""",
        "tender_parts": f"""SELECT publication_number, CASE WHEN status = 'extracted' THEN 'inventory' ELSE 'refused' END AS part, status, count(*) AS files FROM (SELECT publication_number, CASE WHEN {size} = 3 THEN 'error' WHEN {size} IN (1, 2) THEN 'blocked' WHEN {size} = 4 THEN 'captcha' ELSE 'extracted' END AS status
            FROM (SELECT DISTINCT publication_number, url FROM (SELECT publication_number, documents_url AS url FROM lots UNION ALL SELECT publication_number, submission_url FROM lots) WHERE url IS NOT NULL)) GROUP BY 1, 2, 3""",
        "tender_page": """SELECT publication_number, notice_row, title FROM (SELECT *, row_number() OVER (PARTITION BY publication_number ORDER BY loaded_at DESC, notice_row DESC) AS n FROM notices) WHERE n = 1 AND buyer_country = 'ITA'
            ORDER BY publication_date NULLS LAST, publication_number LIMIT 15 OFFSET 15""",
        "tender": "SELECT publication_number, notice_row, title FROM notices WHERE publication_number = (SELECT min(publication_number) FROM notices)",
        "tender_dossiers": f"""SELECT dossier_id, {clean('internal_id')} AS internal_id, {clean('procedure_type')} AS procedure_type, CASE WHEN {clean('deadline_date')} <> '' THEN left({clean('deadline_date')}, 10) ELSE coalesce(left({clean('l.deadline_date')}, 10), '') END AS deadline_date,
            CASE WHEN {clean('deadline_date')} <> '' THEN left({clean('deadline_time')}, 5) WHEN l.deadline_date IS NULL THEN '' ELSE left({clean('l.deadline_time')}, 5) END AS deadline_time
            FROM (SELECT *, list_filter(coalesce(lots, []), lambda x: {clean('x.deadline_date')} <> '')[1] AS l FROM dossiers) WHERE dossier_id < 400""",
        "lookup_notes": "SELECT * FROM (VALUES ('fits', ''), ('other', 'the buyer is there, but no record of it fits'), ('absent', 'the buyer is not in the snapshot')) t(asked, note)",
        "search_scope": "SELECT publication_number, notice_row FROM (SELECT *, row_number() OVER (PARTITION BY publication_number ORDER BY loaded_at DESC, notice_row DESC) AS n FROM notices) WHERE n = 1",
        "uncovered_text": "SELECT string_agg(l || ' (' || n || ')', ', ' ORDER BY l) AS text FROM (SELECT upper(trim(lang)) AS l, count(*) AS n FROM documents WHERE trim(coalesce(lang, '')) <> '' AND upper(trim(lang)) <> 'EN' GROUP BY 1)",
    }
    out["rendered_files"] = out["rendered_files"].replace("EXTRACTED", out["extracted_files"])
    return out
