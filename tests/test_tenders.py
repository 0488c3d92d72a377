import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lotwise.functions import markup, robots
from lotwise.functions import textmatch as M
from lotwise.operators import access, contracts, extract, notice_xml, search, web
from lotwise.plans import scan
from lotwise.sources import files

TEXTS = [
    ("ITA", "Sono richieste lampade a LED, di classe A", "led", False),
    ("ita ", "la scuola serve pasti caldi", "scuola + pasti", True),
    ("FRA", "des lampes LED", None, None),
    ("", "des lampes LED", "led", False),
    (None, "die Schule", None, None),
    ("ELL", "ΟΔΟΣ και ΛΕΔ", "οδος", False),
    ("ITA", None, None, None),
    ("ITA", "", None, None),
]


def test_matching_by_language(spark):
    m = M.matcher({"ita": ["LED", " "], "ELL": ["οδος"]}, near={"a": {"ITA": ["scuola"]}, "b": {"ITA": ["pasti"]}, "window": 20})
    df = spark.createDataFrame([(i, t, x) for i, (t, x, _, _) in enumerate(TEXTS)], "id int, lang string, text string")
    got = {r.id: r.h for r in df.select("id", m.find(F.col("text"), F.col("lang")).alias("h")).collect()}
    for i, (_, _, term, pair) in enumerate(TEXTS):
        assert (got[i].term, got[i].pair) == (term.replace("ς", "σ"), pair) if term else got[i] is None
    cover = {r.id: r.c for r in df.select("id", m.covers(F.col("lang")).alias("c")).collect()}
    assert [cover[i] for i in range(5)] == [True, True, False, True, True]
    assert m.describe() == "2 term(s), 1+1 paired root(s) within 20 chars across 2 language(s)"
    assert M.Spec({"A": ["x"]}) and M.matcher({"A": ["x"]}).describe() == "1 term(s) across 1 language(s)"
    assert M.LanguageMatcher(M.Spec()).describe() == "empty search" and M.LanguageMatcher(M.Spec({}, {"A": ["x"]})).describe() == "1+0 paired root(s) within 60 chars across 1 language(s)"


def test_near_counts_bytes(spark):
    text = "àààà b"
    m = lambda w: M.matcher(near={"a": {"*": ["àààà"]}, "b": {"*": ["b"]}, "window": w})
    df = spark.createDataFrame([(text, "bùùùùùc", "X")], "t string, u string, l string")
    assert df.select(m(1).find(F.col("t"), F.col("l"))).first()[0].term == "àààà + b"
    n = lambda w: M.matcher(near={"a": {"*": ["b"]}, "b": {"*": ["c"]}, "window": w})
    assert df.select(n(9).find(F.col("u"), F.col("l"))).first()[0] is None
    assert df.select(n(10).find(F.col("u"), F.col("l"))).first()[0] is not None


def test_specs_and_expressions(spark):
    assert M.Spec({}, {}, {"ITA": ["x"]}).empty and not M.Spec({}, {"ITA": ["x"]}).empty
    assert M.matcher() is None and isinstance(M.matcher({"A": ["x"]}, regex="y"), M.LanguageMatcher)
    for bad in ("(", "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError):
            M.matcher(regex=bad)
    df = spark.createDataFrame([("ОТПАД и ÉTRE",)], "t string")
    find = lambda p: df.select(M.matcher(regex=p).find(F.col("t"), F.lit(""))).first()[0]
    assert find("отпад").start == 1 and find(r"\bétre") is None and find("(?:отпад)") is None


def test_snippets(spark):
    df = spark.createDataFrame([("x" * 300 + " hit " + "y" * 300,), ("hit",)], "t string")
    h = F.struct((F.locate("hit", "t")).alias("start"), (F.locate("hit", "t") + 3).alias("end"))
    long, short = [r[0] for r in df.select(M.snippet(F.col("t"), h, 10)).collect()]
    assert long == "…xxxxxxxxx hit yyyyyyyyy…" and short == "hit"
    one = spark.createDataFrame([("  a  b\t\n",)], "t string").select(M.collapse(F.col("t")), M.dehyphenate(F.lit("Ver-\nband, x-\n1")), M.truncate(F.lit("ab cd"), 3), M.passage_key(F.lit("… Ab c…"))).first()
    assert list(one) == ["a b", "Verband, x-\n1", "ab…", "ab c"]


@pytest.mark.parametrize(
    ("tokens", "exact", "prefixes"),
    [(["34100000-8"], ["34100000"], []), (["341*", "341XXXXX"], [], ["341"]), (["34100000, 45000000;45"], ["34100000", "45000000"], ["45"])],
)
def test_category_codes(tokens, exact, prefixes):
    assert search.cpv_tokens(tokens) == (exact, prefixes)


@pytest.mark.parametrize("token", ["3X4*", "3*", "341000001", "abc", "*"])
def test_bad_category_codes(token):
    with pytest.raises(search.QueryError):
        search.cpv_token(token)


def test_compiled_query(spark):
    f = search.Filters(query="notice-type=a", cpv=["34100000", "45*"], country=["ita"], published_from="2024-01-31", keywords='new "roof"', order="asc")
    text, predicate = search.compile_filters(f)
    assert text == '(notice-type=a) AND (classification-cpv=34100000 OR classification-cpv=45*) AND buyer-country=ITA AND publication-date>=20240131 AND FT ~ ("new roof") SORT BY publication-date ASC'
    rows = [(1, ["45111"], "ITA", "a", "2024-02-01+01:00", "A New Roof"), (2, ["45111"], "ITA", "b", "2024-02-01", "new roof"), (3, None, "ITA", "a", "2024-02-01", "new roof"), (4, ["45111"], "ITA", "a", None, "new roof")]
    df = spark.createDataFrame(rows, "publication_number int, cpv array<string>, buyer_country string, notice_type string, publication_date string, title string")
    assert [r.publication_number for r in df.filter(predicate).collect()] == [1]
    again = search.parse(text.partition(" SORT")[0])
    assert [r.publication_number for r in df.filter(again).collect()] == [1]
    page, total = search.search(df, search.Filters(country=["ITA"]), page=2, limit=3)
    assert [r.publication_number for r in page.collect()] == [4] and total.first().total == 4
    for bad in (search.Filters(), search.Filters(country=[" "]), search.Filters(country=["A"], order="up"), search.Filters(published_to="2024")):
        with pytest.raises(search.QueryError):
            search.compile_filters(bad)
    for bad in ("buyer-country", "x=1", "(buyer-country=A", "buyer-country=A buyer-country=B"):
        with pytest.raises(search.QueryError):
            search.parse(bad)


CONTENT = """<n:Notice xmlns:n="u"><c:NoticeLanguageCode>ita</c:NoticeLanguageCode><Description languageID="ITA">Fornitura &amp;amp; posa&nbsp;in opera</Description>
<AwardingCriterion><SubordinateAwardingCriterion><ParameterCode listName="number-threshold"/><ParameterNumeric>9</ParameterNumeric><Name>Prezzo</Name><Name>basso</Name></SubordinateAwardingCriterion>
<SubordinateAwardingCriterion><P><ParameterCode listName="number-weight">w</ParameterCode><ParameterNumeric>40</ParameterNumeric></P><Description>Tempi di con-
segna</Description></SubordinateAwardingCriterion><SubordinateAwardingCriterion/></AwardingCriterion>
<ProcurementTypeCode listName="strategic-procurement">env</ProcurementTypeCode><ProcurementTypeCode listName="other">x</ProcurementTypeCode><URI>http://a/b</URI><URI>ftp://x</URI></n:Notice>"""

DOSSIER = """<Notice><ContractFolderID>F-1</ContractFolderID><UBLExtensions><UBLExtension><ExtensionContent><EformsExtension><Organizations>
<Organization><Company><PartyIdentification><ID>O1</ID></PartyIdentification><PartyName><Name>Town</Name></PartyName><WebsiteURI>http://town</WebsiteURI><PartyLegalEntity><CompanyID>123</CompanyID></PartyLegalEntity></Company></Organization>
<Organization><Company><PartyIdentification><ID>O2</ID></PartyIdentification><PartyName><Name>Court</Name></PartyName><WebsiteURI>http://court</WebsiteURI></Company></Organization><Organization/>
</Organizations></EformsExtension></ExtensionContent></UBLExtension></UBLExtensions>
<ContractingParty><Party><PartyIdentification><ID>O1</ID></PartyIdentification></Party></ContractingParty>
<ProcurementProjectLot><ID>L1</ID><ProcurementProject><Name>Lamps</Name><RequestedTenderTotal><EstimatedOverallContractAmount currencyID="EUR">10.5</EstimatedOverallContractAmount></RequestedTenderTotal>
<MainCommodityClassification><ItemClassificationCode>31500000</ItemClassificationCode></MainCommodityClassification><AdditionalCommodityClassification><ItemClassificationCode>31500000</ItemClassificationCode></AdditionalCommodityClassification></ProcurementProject>
<TenderingProcess><TenderSubmissionDeadlinePeriod><EndDate>2025-05-06+02:00</EndDate><EndTime>12:00:00+02:00</EndTime></TenderSubmissionDeadlinePeriod></TenderingProcess>
<TenderingTerms><AwardingTerms><AwardingCriterion><SubordinateAwardingCriterion><Name>Price</Name></SubordinateAwardingCriterion></AwardingCriterion>
<CallForTendersDocumentReference><ID>REF 7</ID></CallForTendersDocumentReference>
<AppealTerms><AppealReceiverParty><PartyIdentification><ID>O2</ID></PartyIdentification></AppealReceiverParty></AppealTerms></TenderingTerms></ProcurementProjectLot></Notice>"""


def test_content():
    got = notice_xml.content(CONTENT)
    assert [(c["name"], c["description"], c["weight"], c["lang"]) for c in got["criteria"]] == [("Prezzo basso", "", "", "ITA"), ("", "Tempi di consegna", "40", "ITA")]
    assert got["descriptions"] == ["Fornitura & posa in opera"] and got["strategic"] == ["env"] and got["document_urls"] == ["http://a/b"] and got["language"] == "ITA"
    assert notice_xml.content("<r/>")["criteria"] == []


def test_dossier_of_an_unclosed_element():
    got = notice_xml.dossier(DOSSIER)  # AwardingTerms is never closed
    assert [(o["name"], o["roles"]) for o in got["organizations"]] == [("Town", ["buyer"]), ("Court", [])]
    lot = got["lots"][0]
    assert (lot["title"], lot["value"], lot["currency"], lot["cpv"], lot["deadline_date"], lot["deadline_time"]) == ("Lamps", "10.5", "EUR", ["31500000"], "2025-05-06", "12:00")
    assert [c["name"] for c in lot["criteria"]] == ["Price"] and got["deadline_date"] == "2025-05-06" and got["internal_id"] == "F-1"
    closed = notice_xml.dossier(DOSSIER.replace("</AwardingCriterion>", "</AwardingCriterion></AwardingTerms>"))
    assert closed["internal_id"] == "REF 7" and closed["organizations"][1]["roles"] == ["appeal-body"]
    assert [(x["url"], x["role"]) for x in closed["links"]] == [("http://town", "buyer-website"), ("http://court", "appeal-body")]
    assert notice_xml.best_documents_link(closed["links"]) is None


def test_unreadable_notices_are_rows(spark):
    df = spark.createDataFrame([(1, DOSSIER, "x"), (2, "<a><b>", "x"), (3, None, "x"), (4, "", "x")], "id int, xml string, failure string")
    for what in ("content", "dossier"):
        got = {r.id: r.failure for r in notice_xml.shred(df, "id", "xml", what).collect()}
        assert got[1] is None and all(got[i] for i in (2, 3, 4))


@pytest.mark.parametrize(
    ("body", "agent", "path", "want"),
    [
        ("User-agent: *\nDisallow: /a", "bot", "/a/b", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "bot", "/a/b", True),
        ("User-agent: *\nDisallow:", "bot", "/a", True),
        ("User-agent: x\nUser-agent: y\n\nDisallow: /", "my-Y/1", "/", False),
        ("User-agent: *\nDisallow: /\nUser-agent: bot\nDisallow: /z", "bot", "/a", True),
        ("User-agent: *\nDisallow: /*.pdf$", "bot", "/a.pdf", False),
        ("User-agent: *\nDisallow: /*.pdf$", "bot", "/a.pdf.pdf", True),
        ("User-agent: *\nDisallow: /*?id=*&x", "bot", "/q?id=3&x=1", False),
        ("nonsense", "bot", "/", True),
    ],
)
def test_robots(body, agent, path, want):
    assert robots.allowed(robots.parse(body), agent, path) is want


def test_pages():
    page = "<html><head><title>t</title></head><body><p>One &amp; two</p><script>x<y</script><!-- c --><ul><li>a<li>b</ul>5 < 10</p>z"
    assert markup.html_to_text(page) == "One & two\na\nb5 z"
    assert markup.html_to_text("<p>price < 10 euro") == "price < 10 euro" and markup.xml_to_text("<a>3 < 4") == "3 < 4"  # nothing closes it
    links = '<a href="/f.pdf">Bando <b>1</b></a><a href=#x>no</a><A HREF=\'http://other.org/x\'>o</A><a href="http://www.town.gov.it/f.pdf#p">again</a><a href="mailto:x">m</a>'
    assert markup.candidates("http://www.town.gov.it/a/", links) == [("http://www.town.gov.it/f.pdf", "Bando 1")]
    odd = "<a title=\"x > y\" href='/g.pdf?a=1&amp;b=2'>G\n\n<a href=/inner>in</a></a><a name=top>none</a><a href=/open>never closed"
    assert markup.anchors(odd) == [("/g.pdf?a=1&b=2", "G in")]


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr("__MACOSX/x" if name == "mac" else name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def _pdf(stream, flate=False):
    body = zlib.compress(stream) if flate else stream
    return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length 1" + (b" /Filter /FlateDecode" if flate else b"") + b">> stream\n" + body + b"\nendstream endobj\n%%EOF"


def test_extraction():
    docx = _zip(word__document_dot_xml="<w:p><w:t>One</w:t></w:p><w:p>Two</w:p>")
    inner = _zip(x_dot_txt="deep")
    nested = _zip(allegato_dot_txt="last", disciplinare_dot_txt="first", inner_dot_zip=inner, mac="no")
    got = {n: extract.extract(n, t, d) for n, t, d in [("a.docx", "", docx), ("b.zip", "", nested), ("c", "text/html", b"<p>x</p>"), ("d.bin", "", b"\x00\xff\x00"), ("e.txt", "", b""), ("f.pdf", "", b"%PDF-1.4 cut"), ("g.zip", "", b"PK\x03\x04bad")]}
    assert (got["a.docx"][0].kind, got["a.docx"][0].text) == ("docx", "One\nTwo")
    assert [(f.name, f.text, f.container) for f in got["b.zip"]] == [("disciplinare.txt", "first", "b.zip"), ("allegato.txt", "last", "b.zip"), ("x.txt", "deep", "b.zip")]
    assert got["c"][0].text == "x" and got["d.bin"][0].status == "unsupported" and (got["e.txt"][0].kind, got["e.txt"][0].status) == ("unknown", "damaged") and got["f.pdf"][0].status == "damaged" and got["g.zip"][0].status == "damaged"
    for flate in (False, True):
        pdf = extract.extract("x.pdf", "", _pdf(b"BT /F1 12 Tf 72 700 Td (Hello) Tj 0 -14 Td [(W) -20 (orld)] TJ ET", flate))[0]
        assert (pdf.status, pdf.text, pdf.pages) == ("extracted", "Hello\nWorld", 1)
    assert extract.extract("x.pdf", "", _pdf(b"q 1 0 0 1 0 0 cm /Im0 Do Q"))[0].status == "no-text-layer"
    many = extract.extract("m.zip", "", _zip(**{f"f{i}_dot_txt": "x" for i in range(5)}), extract.Limits(members=3))
    assert len(many) == 4 and many[-1].name == "2 more"
    assert extract.extract("t.txt", "", b"abcdef", extract.Limits(chars=3))[0].truncated


def test_envelopes():
    oid, text = bytes.fromhex("06092a864886f70d010701"), b"hello"
    der = lambda tag, body: bytes([tag, len(body)]) + body
    plain = der(0x30, bytes.fromhex("06092a864886f70d010702") + der(0xA0, der(0x30, der(0x30, oid + der(0xA0, der(0x04, text))))))
    open_ended = b"\x30\x80" + oid + b"\xa0\x80\x24\x80" + der(0x04, b"hel") + der(0x04, b"lo") + b"\0\0\0\0\0\0"
    import base64

    for data in (plain, open_ended, base64.b64encode(plain), b"-----BEGIN PKCS7-----\n" + base64.b64encode(plain) + b"\n-----END PKCS7-----"):
        assert extract.extract("x.txt.p7m", "", data)[0].text == "hello"
    assert "detached" in extract.extract("x.p7m", "", der(0x30, oid))[0].reason
    assert extract.extract("x.p7m", "", b"garbage!")[0].status == "damaged"


def test_files_table(spark):
    df = spark.createDataFrame([(1, "a.txt", None, bytearray(b"x"), "t"), (2, None, None, None, "t")], "id int, name string, content_type string, data binary, text string")
    assert [(r.id, r.seq, r.status, r.chars) for r in extract.extract_files(df, "id").orderBy("id").collect()] == [(1, 0, "extracted", 1), (2, 0, "damaged", 0)]


def test_budgets_and_caps(spark):
    df = spark.createDataFrame([(1, "g", "aaaa"), (2, "g", None), (3, "g", "bbbb"), (4, "g", "cccc"), (5, "h", "dddd")], "id int, g string, text string")
    got = {r.id: (r.given, r.withheld) for r in web.text_budget(df, ["g"], "id", "text", 3, 5).collect()}
    assert got == {1: ("aaa", False), 2: ("", False), 3: ("bb", False), 4: ("", True), 5: ("ddd", False)}
    many = spark.createDataFrame([(i, "g" if i % 3 else None, i % 5, str(i)) for i in range(-7, 90)], "n int, g string, v int, s string")
    whole, cells = web.running(many, ["g"], ["s"], F.col("v"), "before"), web.running(many, ["g"], ["n"], F.col("v"), "before", step=10)
    for rows, order in ((whole.collect(), lambda r: r.s), (cells.collect(), lambda r: r.n)):
        for g in ("g", None):
            total = 0
            for r in sorted((r for r in rows if r.g == g), key=order):
                assert r.before == total
                total += r.v
    assert len(cells.columns) == 5
    kept, left = web.ranked_cap(df, ["g"], web.name_rank(F.col("text")), "id", 2)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 5] and [(r.g, r.skipped) for r in left.collect()] == [("g", 2)]
    old = spark.createDataFrame([(i, f"2025-01-0{1 + i // 3} 00:00:0{i}", 10) for i in range(6)], "key int, at string, n long").withColumn("at", F.to_timestamp("at"))
    assert sorted(r.key for r in web.evict(old, "n", "at", 50).collect()) == [0, 1]
    assert web.evict(old, "n", "at", 60).count() == 0


def test_lookup(spark):
    rows = [("a", "1", "10.0", "99", "34"), ("b", "1", '{"v": 1}', "5", "34"), ("c", "1", None, "10.001", "45"), ("d", "2", "10", "10", "34"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "cig string, cf_amministrazione_appaltante string, importo_lotto string, importo_complessivo_gara string, cod_cpv string")
    found, stats = contracts.lookup(df, ["1"], value=10.0)
    assert [r.cig for r in found.collect()] == ["a", "c"] and stats.first().asDict() == {"scanned": 5, "candidates": 3, "malformed": 1, "matched": 2, "limit_hit": False}
    assert [r.cig for r in contracts.lookup(df, ["1"], ["34"])[0].collect()] == ["a"]
    with pytest.raises(ValueError):
        contracts.lookup(df, [" "])


def test_notice_evidence(spark):
    crit = spark.createDataFrame([("n", i, "ITA", t) for i, t in enumerate(["LED lamps grade A", "led lamps grade a", "nothing"])], "pub string, seq int, lang string, text string")
    rest = spark.createDataFrame([("n", 2, 0, "ITA", "lamps LED"), ("n", 2, 1, "ITA", "LED lamps"), ("n", 2, 2, "FRA", "LED"), ("m", 2, 0, None, "led")], "pub string, tier int, seq int, lang string, text string")
    got = sorted((r["pub"], r.tier, r.seq, r.place) for r in scan.notices(crit, rest, M.matcher({"ITA": ["led"]}), "pub").collect())
    assert got == [("m", 2, 0, 1), ("n", 1, 0, 1), ("n", 2, 0, 2)]


def test_answers_and_names(spark):
    rows = [(200, "text/plain", "x", True, False), (404, None, None, True, False), (503, "text/html", "x", True, False), (None, None, None, True, True), (200, "text/html", "<i class=h-captcha>", True, False), (200, None, None, False, False)]
    df = spark.createDataFrame(rows, "code int, kind string, body string, allowed boolean, failed boolean")
    got = [r[0] for r in df.select(web.fetch_status(F.col("code"), F.col("kind"), F.col("body"), F.col("allowed"), F.col("failed"))).collect()]
    assert got == ["fetched", "blocked", "blocked", "error", "captcha", "robots-denied"]
    urls = [("http://a.it", None), ("http://a.it/x/y.pdf?q=1#z", None), ("http://a.it/x", 'attachment; filename="bando \\"1\\".pdf"'), ("http://a.it/x/", "inline; filename=b.pdf"), (None, None)]
    df = spark.createDataFrame(urls, "url string, said string")
    got = [tuple(r) for r in df.select(web.request_path(F.col("url")), web.file_name(F.col("said"), F.col("url"))).collect()]
    assert got == [("/", None), ("/x/y.pdf?q=1", "y.pdf"), ("/x", 'bando "1".pdf'), ("/x/", "b.pdf"), (None, None)]


def test_deadlines_of_any_format(spark):
    rows = [(1, "03/04/2025 12:00"), (2, "2025-04-03T23:00:00-05:00"), (3, "4 aprile 2025"), (4, "2025-01-01, 2025-04-03"), (5, "n.d."), (6, None)]
    df = spark.createDataFrame(rows, "publication_number int, deadline string")
    days = {r[0]: r[1] for r in df.select("publication_number", search.written_days(F.col("deadline"))).collect()}
    assert days == {1: ["20250403"], 2: ["20250403"], 3: ["20250404"], 4: ["20250101", "20250403"], 5: [], 6: []}
    found = lambda **b: [r[0] for r in df.filter(search.compile_filters(search.Filters(**b))[1]).collect()]
    assert found(deadline_from="2025-04-03", deadline_to="20250403") == [1, 2, 4] and found(deadline_to="2025-01-31") == [4]
    stored = df.withColumn("days", search.written_days(F.col("deadline")))
    predicate = search.parse("deadline-receipt-tender-date-lot=20250404", search.Columns(deadline_days="days"))
    assert [r[0] for r in stored.filter(predicate).collect()] == [3]


def test_many_numbers_are_not_cut(spark):
    df = spark.createDataFrame([(str(i),) for i in range(400)] + [(None,)], "publication_number string")
    assert search.get_many(df, [str(i) for i in range(390)]).count() == 390 and search.get_many(df, []).count() == 0


def test_robots_by_host(spark):
    robots_table = spark.createDataFrame([("A.it", 200, "User-agent: *\nDisallow: /p", False), ("b.it", 404, "Disallow", False), ("c.it", None, None, True), ("a.it", 500, "x", False), (None, 200, "x", False)], "host string, code int, body string, failed boolean")
    urls = spark.createDataFrame([(1, "http://a.it/p/1", "kept"), (2, "http://a.it/q", ""), (3, "https://b.it/p", ""), (4, "http://c.it/", ""), (5, "http://d.it/", ""), (6, None, "")], "id int, url string, allowed string")
    got = {r.id: (r.allowed, r.failed) for r in access.decide(urls, robots_table, "bot").collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, False), 4: (False, True), 5: (True, False), 6: (True, False)}
    assert access.decide(urls.limit(0), robots_table, "bot").count() == 0 and access.decide(urls, robots_table.limit(0), "bot").filter("allowed").count() == 6


def test_snapshot(spark, tmp_path):
    lines = ['{"CIG": "a", "cf_amministrazione_appaltante": "1", "importo_lotto": "10.0", "cod_cpv": "34"}', "", '{"cig": "b", "cf_amministrazione_appaltante": "1", "importo_lotto": {"v": 1}}', '{"cig": "c", "cf_amministrazione_appaltante": "22", "oggetto_gara": "1 x"}', "{cut 1", '{"cig": "d", "cf_amministrazione_appaltante": "2"}', '{"cig": "e", "cf_amministrazione_appaltante": "1", "importo_lotto": null, "importo_complessivo_gara": 10, "Esito": "OK"}']
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("folder/", "")
        z.writestr("one.json", "\n".join(lines))
        z.writestr("two.json", lines[0].replace('"a"', '"f"') + "\r\n")
    archives = spark.createDataFrame([("s.zip", bytearray(data.getvalue())), ("bad.zip", bytearray(b"no")), ("none.zip", None)], "path string, content binary")
    found, stats = contracts.lookup_archives(archives.filter("path = 's.zip'"), ["1"], value=10.0)
    assert [(r.cig, r.esito) for r in found.collect()] == [("a", ""), ("e", "OK"), ("f", "")]
    assert stats.first().asDict() == {"scanned": 8, "candidates": 6, "malformed": 2, "matched": 3, "first_problem": "a number is none", "limit_hit": False}
    assert contracts.lookup_archives(archives, ["1"])[1].first().malformed == 4 and contracts.lookup_archives(archives.limit(0), ["1"])[1].first().scanned == 0
    (tmp_path / "s.zip").write_bytes(data.getvalue())
    stored = files.read_files(spark, str(tmp_path), "*.zip").withColumnRenamed("data", "content")
    assert [r.cig for r in contracts.lookup_archives(stored, ["1"], ["34"])[0].collect()] == ["a", "f"]
    assert [(r.data, r.failure) for r in files.read_files(spark, str(tmp_path), most=3).collect()] == [(None, "the file is too long")]
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "no archive.zip").write_bytes(b"no")
    apart, counts = contracts.lookup_lines(files.folder_lines(spark, str(tmp_path), needles=["1"]), ["1"], value=10.0)
    assert [r.cig for r in apart.collect()] == ["a", "e", "f"] and counts.first().asDict() | {"first_problem": ""} == {"scanned": 8, "candidates": 7, "malformed": 3, "matched": 3, "first_problem": "", "limit_hit": False}
    assert contracts.lookup_lines(files.folder_lines(spark, str(tmp_path)), ["1"], value=10.0)[1].first().candidates == 7  # without a prefilter
    buyers = spark.createDataFrame([("n", [("O1", " 7 ", ["buyer"]), ("O2", "8", ["buyer"])]), ("m", [("O1", "", ["buyer"])]), ("k", None)], "publication_number string, organizations array<struct<id:string,company_id:string,roles:array<string>>>")
    assert [tuple(r) for r in contracts.asked_by(buyers).collect()] == [("n", "7", None)]
    amounts = spark.createDataFrame([("n", "10.5"), ("x", "1")], "publication_number string, total_value string")
    assert [tuple(r) for r in contracts.asked_by(buyers, values=amounts).collect()] == [("n", "7", 10.5)]


def _objects(*bodies, tail=b"trailer <</Root 1 0 R>>"):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj " % (i + 1) + b + b" endobj\n" for i, b in enumerate(bodies)) + tail + b"\n%%EOF"


def _stream(body, head=b""):
    packed = zlib.compress(body)
    return b"<</Length %d /Filter /FlateDecode " % len(packed) + head + b">> stream\n" + packed + b"\nendstream"


CATALOG = (b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [4 0 R 3 0 R] /Resources <</Font <</F1 5 0 R /F2 6 0 R>> /XObject <</X 9 0 R>>>>>>")


def test_pdf_fonts_pages_and_forms():
    cmap = b"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00e8> <20ac>] endbfrange endcmap"
    bodies = [
        *CATALOG,
        b"<</Type /Page /Contents [7 0 R]>>",
        b"<</Type /Page /Contents 8 0 R>>",
        b"<</Subtype /Type1 /FirstChar 65 /Widths [1000 250] /Encoding <</Differences [66 /eacute /uni20AC /space /fi /nonsense]>>>>",
        b"<</Subtype /Type0 /ToUnicode 10 0 R /DescendantFonts [<</DW 500 /W [1 [1000] 16 18 500]>>]>>",
        _stream(b"q 2 0 0 2 0 0 cm BT /F2 10 Tf 36 350 Td <00010010> Tj <00110012> Tj 40 0 Td <00200021> Tj ET Q BI /W 1 ID (x) Tj EI"),
        _stream(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (A) Tj 10.5 0 Td (\\102C\\104E) Tj ET % (no) Tj\nBT /F1 10 Tf 72 660 Td [(A) -3000 (A)] TJ ET /X Do"),
        _stream(b"BT /F1 10 Tf 0 0 Td (A) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 72 648]"),
        _stream(cmap),
    ]
    got = extract.extract("x.pdf", "", _objects(*bodies))[0]
    # the tree's order of pages; widths decide on blanks; a gap of three sizes is a column
    assert (got.status, got.pages) == ("extracted", 2) and got.text == "Aé€ fi\n\nA   A\nA\n\nHiabc   è€"


def test_pdf_objects_in_streams_and_failures():
    first = b"<</Type /Page /Contents 6 0 R>>"
    index = b"3 0 "
    packed = _stream(index + first, b"/Type /ObjStm /N 1 /First %d" % len(index))
    pages = b"<</Type /Pages /Kids [3 0 R]>>"
    content = b"<</Length 8 0 R /Filter [/ASCIIHexDecode]>> stream\n" + b"BT 12 TL 0 0 Td (one) Tj (two) ' ET".hex().encode() + b">\nendstream"
    got = extract.extract("x.pdf", "", _objects(CATALOG[0], pages, b"null", packed, b"5", content).replace(b"3 0 obj null endobj\n", b""))[0]
    assert (got.status, got.text) == ("extracted", "one\ntwo")
    locked = extract.extract("x.pdf", "", _objects(*CATALOG, tail=b"trailer <</Root 1 0 R /Encrypt 9 0 R>>"))[0]
    assert locked.status == "encrypted"
    bad = _objects(CATALOG[0], b"<</Type /Pages /Kids [3 0 R]>>", b"<</Type /Page /Contents 4 0 R>>", b"<</Filter /FlateDecode>> stream\nnot deflated\nendstream")
    assert extract.extract("x.pdf", "", bad)[0].status == "damaged"
    unmapped = _objects(CATALOG[0], b"<</Type /Pages /Kids [3 0 R]>>", b"<</Type /Page /Contents 4 0 R /Resources <</Font <</F 5 0 R>>>>>>", _stream(b"BT /F 9 Tf <0001> Tj ET"), b"<</Subtype /Type0>>")
    assert extract.extract("x.pdf", "", unmapped)[0].status == "no-text-layer"
    stray = _objects(CATALOG[0], b"<</Type /Pages /Kids [3 0 R]>>", b"<</Type /Page /Contents 4 0 R>>", _stream(b"BT ) > (kept) Tj ET"))
    assert extract.extract("x.pdf", "", stray)[0].text == "kept"
    for junk in (b"%PDF-1.4\n1 0 obj (", b"%PDF-1.4\n1 0 obj << /A [ 1 2", b"%PDF-", b"%PDF-1.4 9 0 obj << /Type /Pages /Kids [9 0 R] >> endobj"):
        assert extract.extract("x.pdf", "", junk)[0].status == "damaged"
