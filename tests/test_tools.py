import pytest
from pyspark.sql import functions as F

from lotwise.functions import textmatch as M
from lotwise.operators import contracts, web
from lotwise.operators import search as selection
from lotwise.operators.search import QueryError
from lotwise.plans import rendering, tools
from tests.test_tenders import CONTENT, DOSSIER


def test_documents_of_a_notice(spark):
    rows = [("1", "xml", "MUL", "u", bytearray("aé".encode())), ("1", "pdf", "ENG", "p", bytearray(b"%PDF"))]
    df = spark.createDataFrame(rows, "publication_number string, form string, language string, url string, data binary")
    assert tools.get_tender_document(df, "1", most=2).first().asDict() == {"publication_number": "1", "form": "xml", "language": "MUL", "url": "u", "text": "a", "truncated": True, "note": None}
    assert tools.get_tender_document(df, "1", "pdf").first().text is None
    one = spark.createDataFrame([("1", "t")], "publication_number string, title string")
    assert tools.get_tender(one, " 1 ").first().title == "t"
    for bad in (lambda: tools.get_tender_document(df, " "), lambda: tools.get_tender_document(df, "1", "doc"), lambda: tools.get_tender(df, ""), lambda: tools.get_tender(df, "9")):
        with pytest.raises(QueryError):
            bad()


def test_scanning_notices(spark):
    df = spark.createDataFrame([("1", CONTENT), ("2", DOSSIER), ("3", "<a>")], "publication_number string, xml string")
    matches, notices, uncovered = tools.scan_tenders(df, M.matcher({"ITA": ["prezzo", "posa"]}))
    assert [(r.publication_number, r.tier, r.term) for r in matches.orderBy("place").collect()] == [("1", 1, "prezzo"), ("1", 2, "posa")]
    got = {r.publication_number: (r.criteria_published, r.matches, r.failure is None) for r in notices.collect()}
    assert got["1"] == (True, 2, True) and got["2"] == (True, 0, True) and got["3"][1:] == (0, False)
    assert uncovered.count() == 0
    few = tools.scan_tenders(df, M.matcher({"ITA": ["prezzo"]}), include_unmatched=False, include_criteria=True)[1].collect()
    assert {r.publication_number: len(r.criteria or []) for r in few} == {"1": 2, "3": 0}  # failures are never left out
    assert tools.get_tender_dossier(df, ["2", "9"]).first().procedure_type == ""


def test_scanning_whole_criteria(spark):
    long = "Qualità del servizio. " * 40 + "Premio per la posa notturna."
    xml = f"<n:Notice xmlns:n='u'><c:NoticeLanguageCode>ita</c:NoticeLanguageCode><AwardingCriterion><SubordinateAwardingCriterion><Description languageID='ITA'>{long}</Description></SubordinateAwardingCriterion></AwardingCriterion></n:Notice>"
    df = spark.createDataFrame([("1", xml)], "publication_number string, xml string")
    rows = tools.scan_tenders(df, M.matcher({"ITA": ["posa"]}))[0].collect()
    assert [(r.tier, r.term) for r in rows] == [(1, "posa")] and "posa notturna" in rows[0].snippet and len(rows[0].snippet) <= 501
    apart = M.matcher({"ITA": ["qualità", "posa"]}), M.matcher({"ITA": ["notturna"]})
    assert [[r.tier for r in tools.scan_tenders(df, m)[0].collect()] for m in apart] == [[1], [1]]


def test_lookup_notes(spark):
    df = spark.createDataFrame([("a", "1", "5", "5", "34")], "cig string, cf_amministrazione_appaltante string, importo_lotto string, importo_complessivo_gara string, cod_cpv string")
    note = lambda *a: tools.lookup_contracts(df, *a)[1].first().note
    assert note(["1"]) is None and note(["1"], ["45"]) == "the buyer is there, but no record of it fits" and note(["2"]) == "the buyer is not in the snapshot"


def test_rendering(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x")], "id int, cpv array<string>, note string").collect()
    assert tools.render("Found", rows, ["id", "cpv", "note"], "end") == "Found\n1. id: 1; cpv: a, b\n2. id: 2; note: x\nend"
    assert tools.render("Found", [], ["id"]) == "Found\n(none)" and tools.first_non_empty(None, " ", " a") == "a"


def test_scopes(spark):
    rows = [("a", "2025-01-01", "2025-05-01", 1), ("a", "2025-02-01", "2025-03-01", 2), ("a", None, "2026-01-01", 3), ("b", "2025-01-01", "1 giugno 2025", 4), ("c", "2025-01-01", None, 5)]
    df = spark.createDataFrame(rows, "publication_number string, loaded_at string, deadline string, n int")
    assert sorted(r.n for r in selection.in_scope(df, " latest ").collect()) == [2, 4, 5]
    assert [r.n for r in selection.in_scope(df, "ACTIVE", "2025-04-01").collect()] == [4] and selection.in_scope(df).count() == 5
    page, total = tools.search_tenders(df, selection.Filters(deadline_from="2025-01-01", sort_by="n"), scope="LATEST")
    assert total.first().total == 2 and page.columns == df.columns
    for bad in (lambda: selection.in_scope(df, "NEW"), lambda: selection.in_scope(df, "ACTIVE"), lambda: selection.in_scope(df.drop("loaded_at"), "LATEST")):
        with pytest.raises(QueryError):
            bad()


def test_files_in_parts(spark):
    links = spark.createDataFrame([("t", "http://a.it/x.txt", "tender-documents", 1), ("t", "http://a.it/bin", "submission-endpoint", 2), ("t", "nowhere", "tender-documents", 3), ("t", "http://a.it/court", "appeal-body", 4)], "tender string, url string, role string, seq int")
    fetched = spark.createDataFrame([("http://a.it/x.txt", 200, "text/plain", None, bytearray(b"led lamps"), True, False), ("http://a.it/bin", 200, "x/y", None, bytearray(b"\x00\xff"), True, False), ("http://b.it/own", 404, None, None, None, True, False)], "url string, code int, content_type string, filename string, data binary, allowed boolean, failed boolean")
    languages = spark.createDataFrame([("t", "ITA")], "tender string, lang string")
    got = tools.scan_tender_documents(links, fetched, languages, M.matcher({"ITA": ["led"]}))
    assert [r.url for r in got["inventory"].collect()] == ["http://a.it/x.txt"] and "text" not in got["inventory"].columns
    assert [r.url for r in got["unreadable"].collect()] == ["http://a.it/bin"] and [(r.url, r.status) for r in got["refused"].collect()] == [("nowhere", "error")]
    assert got["matches"].first().term == "led" and got["tenders"].first().files == 3
    own, _ = tools.fetch_tender_documents(links, fetched, urls=[" http://b.it/own ", "", "http://b.it/own"])
    assert [(r.tender, r.url, r.role, r.status) for r in own.collect()] == [("requested", "http://b.it/own", "requested", "blocked")]
    assert tools.targets(links, all_roles=True).count() == 4
    with pytest.raises(QueryError):
        tools.targets(links, urls=[" "])


def test_lines_for_people(spark):
    df = spark.createDataFrame([(" ", "t", None, "b"), ("x", "", "1", None)], "a string, b string, w string, c string")
    got = [tuple(r) for r in df.select(rendering.first_non_empty(F.col("a"), F.col("b")), rendering.join_non_empty(" / ", F.col("a"), F.col("b"), F.col("c")), rendering.criterion_line(F.col("w"), F.col("b"))).collect()]
    assert got == [("t", "t / b", "[-] t"), ("x", "x", "[1] ")]
    counts = spark.createDataFrame([("FRA", 2), ("DEU", 1)], "language string, texts long")
    assert rendering.language_list(counts).first().text == "DEU (1), FRA (2)" and rendering.language_list(counts.limit(0)).first().text == ""
    one = rendering.envelope(spark.createDataFrame([("b", None), ("a", 1)], "k string, v int"), spark.createDataFrame([(2,)], "scanned int"), ["k"])
    assert [r.json for r in one.collect()] == ['{"records":[{"k":"a","v":1},{"k":"b","v":null}],"scanned":2}']


def test_values_of_one_buyer(spark):
    records = spark.createDataFrame([("x", "1", "10.004", "10.00"), ("y", "1", "9.992", "500"), ("z", "1", "3", "10.0"), ("w", "2", "10", "10"), ("v", "1", "abc", "10"), ("u", None, "10", "10"), ("x", "1", "10.004", "10.00")], "cig string, cf_amministrazione_appaltante string, importo_lotto string, importo_complessivo_gara string")
    asked = spark.createDataFrame([(1, "1", 10.0), (2, "3", 10.0), (3, "1", None)], "n int, buyer_code string, value double")
    got = contracts.join_values(asked, records)
    assert sorted(r.cig for r in got.collect()) == ["v", "x", "x", "y", "z"] and set(got.columns) == {*asked.columns, *records.columns}
    use = web.cache_use(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("a",), (None,)], "k string"), "k").first()
    assert (use.hits, use.misses) == (2, 1)
