from lotwise.functions import multilingual as L
from lotwise.functions import textmatch as M
from lotwise.plans import documents
from lotwise.sources import tables
from pyspark.sql import functions as F


def test_values_of_many_shapes(spark):
    assert L.flatten([None, "", True, 3.0, 2.5, ["a", {"fra": "b", "ENG": ["c"]}], {"zz": "y", "aa": "x"}]) == ["true", "3", "2.5", "a", "c", "x"]
    assert L.pick({"ENG": "", "fra": "x"}) == "" and L.pick({}) is None
    assert L.link({"html": {"FRA": "u", "ENG": " "}}, "html", "ENG") == "u" and L.link(None, "xml", "MUL") == ""
    df = spark.createDataFrame([({"fra": "b", "deu": "a"},), ({"MUL": "m", "deu": "a"},), (None,)], "t map<string,string>")
    assert [r[0] for r in df.select(L.pick_variant(F.col("t"))).collect()] == ["a", "m", None]
    body = '{"notices": [{"publication-number": "1-2025", "notice-title": {"eng": "T"}, "classification-cpv": ["1", "1", "2"], "publication-date": "2025-01-02+01:00", "links": {"xml": {"MUL": "x"}}}]}'
    rows = L.summaries(spark.createDataFrame([(body,), ("{",), (None,)], "body string")).collect()
    assert sorted(r.failure for r in rows if r.failure) == ["the answer is empty", "{"]
    rows = [r for r in rows if not r.failure]
    assert len(rows) == 1 and rows[0].title == "T" and rows[0].cpv == ["1", "2"] and rows[0].publication_date == "2025-01-02" and rows[0].xml_url == "x" and rows[0].html_url.endswith("/1-2025")


def test_answers_without_notices(spark):
    bodies = [('{"notices": []}', 200), ('{"message": "bad query", "detail": "near x"}', 400), ('{"notices": [{"publication-number": "1"}]}', 503), ("[1]", 200), ('"x"', 200), ("{}", 200), ('{"publication-number": "2"}', 200), ("x" * 900, None)]
    got = L.summaries(spark.createDataFrame(bodies, "body string, code int"), code="code").collect()
    assert [r.publication_number for r in got if not r.failure] == ["2"]
    assert sorted(len(r.failure) if r.failure.startswith("xx") else r.failure for r in got if r.failure and not r.failure.startswith("xx")) == sorted(["bad query: near x", '{"notices": [{"publication-number": "1"}]}', '"x"', "{}"])
    assert [len(r.failure) for r in got if r.failure and r.failure.startswith("xx")] == [500]


PAGE = b"<a href='/files/allegato.txt'>A</a><a href='/files/disciplinare.txt'>D</a><a href='/files/other.txt'>O</a><a href='/about'>x</a><a href='http://else.org/f.txt'>e</a>"


def test_gathering(spark):
    links = spark.createDataFrame([("t", "http://www.a.it/p", "tender-documents", 1), ("t", "http://www.a.it/p", "submission", 2), ("t", "http://www.a.it/no", "tender-documents", 3), ("t", "", "other", 4), ("u", "http://b.it/x", "tender-documents", 1)], "tender string, url string, role string, seq int")
    fetched = spark.createDataFrame(
        [
            ("http://www.a.it/p", 200, "text/html", None, bytearray(PAGE), True, False),
            ("http://www.a.it/no", 200, "text/html", None, bytearray(b"<div class=g-recaptcha>"), True, False),
            ("http://www.a.it/files/disciplinare.txt", 200, "text/plain", None, bytearray(b"the LED lamps are new"), True, False),
            ("http://www.a.it/files/allegato.txt", 200, "text/plain", None, bytearray(b"x" * 50), True, False),
            ("http://b.it/x", 200, "text/html", None, None, False, False),
        ],
        "url string, code int, content_type string, filename string, data binary, allowed boolean, failed boolean",
    )
    assert {r.reason for r in documents.gather(links, fetched)[0].filter("status = 'robots-denied'").collect()} == {"robots.txt asks programs not to request it"}
    named = fetched.withColumn("disposition", F.lit('attachment; filename="stated.txt"'))
    assert {r.name for r in documents.gather(links, named)[0].filter("status = 'extracted'").collect()} == {"stated.txt"}
    docs, left = documents.gather(links, fetched, files_most=2, total=60)
    rows = {(r.tender, r.url.rpartition("/")[2]): r for r in docs.collect()}
    assert {k: r.status for k, r in rows.items()} == {("t", "p"): "extracted", ("t", "no"): "captcha", ("t", "disciplinare.txt"): "extracted", ("t", "allegato.txt"): "extracted", ("u", "x"): "robots-denied"}
    assert [(r.tender, r.skipped) for r in left.collect()] == [("t", 1)]
    assert rows["t", "allegato.txt"].truncated and sum(len(r.text) for r in rows.values() if r.tender == "t") <= 60
    languages = spark.createDataFrame([("t", "ITA"), ("u", "ITA")], "tender string, lang string")
    matches, counts = documents.search(docs, languages, M.matcher({"ITA": ["led"]}))
    assert [(r.tender, r.name, r.term) for r in matches.collect()] == [("t", "disciplinare.txt", "led")]
    notes = {r.tender: (r.files, r.readable, r.refused, r.matches, r.note) for r in counts.collect()}
    assert notes["u"] == (1, 0, 1, 0, "nothing was retrieved") and notes["t"][:4] == (4, 3, 1, 1)


def test_cache_folder(monkeypatch):
    monkeypatch.delenv("LOTWISE_CACHE", raising=False)
    assert tables.cache_folder() is None and tables.cache_folder(" ", default="/d") == "/d" and tables.cache_folder("OFF", default="/d") is None
    monkeypatch.setenv("LOTWISE_CACHE", "/e")
    assert tables.cache_folder(default="/d") == "/e" and tables.cache_folder("/a") == "/a"
