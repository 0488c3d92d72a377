"""Queries over tenders, documents and contracts, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import textmatch as M
from lotwise.operators import contracts as K
from lotwise.operators import search as S
from lotwise.operators import web as W
from lotwise.plans import scan
from lotwise.sources.tables import read

TERMS = {"EN": ["street lamps", "heating oil"], "IT": ["lampioni", "gasolio"], "DE": ["straßenlampen", "heizöl"]}
NEAR_A, NEAR_B = {"EN": ["school", "buyer"], "IT": ["scuola"]}, {"EN": ["meals", "lamps"], "IT": ["pasti", "lampioni"]}
ANYWHERE = ["euro", "annex"]
REGEX = r"\b(street|heating|lampioni)\s+\w+"
CODES = ["33141230", "9091", "773*"]

_SPACE = r"[\s\x{85}\p{Z}]+"
_LANG = "upper(trim(coalesce(lang, '')))"
_LOW = "replace(lower(replace(text, 'İ', 'I')), 'ς', 'σ')"


def _doc(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents", spread=True)


# --- SQL of hits, made from the same terms -------------------------------------------------


def _sql_hit(terms: list[str]) -> tuple[str, str]:
    """(start, term) of the leftmost term, of equal starts the first listed."""
    if not terms:
        return "NULL::BIGINT", "NULL::VARCHAR"
    at = {t: f"nullif(strpos(low, '{t}'), 0)" for t in terms}
    start = f"least({', '.join(at.values())})"
    return start, "CASE " + " ".join(f"WHEN {a} = {start} THEN '{t}'" for t, a in at.items()) + " END"


def _sql_pair(a: list[str], b: list[str], window: int) -> tuple[str, str]:
    if not a or not b:
        return "NULL::BIGINT", "NULL::VARCHAR"
    starts = {}
    for x in a:
        for y in b:
            px, py = f"nullif(strpos(low, '{x}'), 0)", f"nullif(strpos(low, '{y}'), 0)"
            bx, by = f"octet_length(encode(substr(low, 1, {px} - 1)))", f"octet_length(encode(substr(low, 1, {py} - 1)))"
            gap = f"greatest({by} - ({bx} + {len(x.encode())}), {bx} - ({by} + {len(y.encode())}))"
            starts[f"{x} + {y}"] = f"CASE WHEN {px} IS NOT NULL AND {py} IS NOT NULL AND {gap} BETWEEN 0 AND {window} THEN least({px}, {py}) END"
    start = f"least({', '.join(starts.values())})"
    return start, "CASE " + " ".join(f"WHEN ({s}) = {start} THEN '{t}'" for t, s in starts.items()) + " END"


def _sql_by_language(spec: M.Spec, make) -> tuple[str, str]:
    parts = [("l = ''", make(None))] + [(f"l = '{n}'", make(n)) for n in spec.languages() if n != M.ANY] + [(None, make(M.ANY))]
    out = []
    for k in (0, 1):
        out.append("CASE " + " ".join((f"WHEN {c} THEN {v[k]}" if c else f"ELSE {v[k]}") for c, v in parts) + " END")
    return out[0], out[1]


def _sql_found(spec: M.Spec, pairs: bool = False) -> str:
    """A table expression: documents with l, low, start and term of their hit."""
    if pairs:
        start, term = _sql_by_language(spec, lambda n: _sql_pair(M._of(spec.near_a, n), M._of(spec.near_b, n), spec.window))
    else:
        start, term = _sql_by_language(spec, lambda n: _sql_hit(M._of(spec.terms, n)))
    base = f"(SELECT *, {_LANG} AS l, {_LOW} AS low FROM documents WHERE text IS NOT NULL)"
    return f"(SELECT * FROM (SELECT *, {start} AS start, {term} AS term FROM {base}) WHERE start IS NOT NULL)"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _sql_snippet(start: str = "start", end: str = "start + length(term)", around: int = 180) -> str:
    begin, stop = f"greatest({start} - {around}, 1)", f"least({end} + {around}, length(text) + 1)"
    body = _sql_strip(f"substr(text, {begin}, {stop} - ({begin}))")
    return f"CASE WHEN {begin} > 1 THEN '…' ELSE '' END || {body} || CASE WHEN {stop} <= length(text) THEN '…' ELSE '' END"


_KEY = rf"left(lower(regexp_replace(snippet, '^[…\s\x{{85}}\p{{Z}}]+|[…\s\x{{85}}\p{{Z}}]+$', '', 'g')), 80)"


# --- text search ----------------------------------------------------------------------------


def _find(spark: SparkSession, folder: str, matcher) -> DataFrame:
    return scan.evidence(_doc(spark, folder).filter(F.col("text").isNotNull()), matcher, ["doc_id"], ["source"])


def term_find_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    return _find(spark, folder, M.matcher(TERMS)).select("doc_id", "lang", "term", F.col("start").cast("bigint").alias("start"), "snippet")


def term_find_anywhere(spark: SparkSession, folder: str) -> DataFrame:
    return _find(spark, folder, M.matcher(TERMS, ANYWHERE)).select("doc_id", "lang", "term", F.col("start").cast("bigint").alias("start"))


def near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = _find(spark, folder, M.matcher(near={"a": NEAR_A, "b": NEAR_B}))
    return found.select("doc_id", "lang", "term", F.col("start").cast("bigint").alias("start"))


def regex_find(spark: SparkSession, folder: str) -> DataFrame:
    return _find(spark, folder, M.matcher(regex=REGEX)).select("doc_id", "term")


def passage_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    found = _find(spark, folder, M.matcher(TERMS))
    return scan.first_of_each(found, ["source"], M.passage_key(F.col("snippet")), ["doc_id"]).select("source", "doc_id", "term")


def top_matches_per_source(spark: SparkSession, folder: str) -> DataFrame:
    found = _find(spark, folder, M.matcher(TERMS))
    fresh = scan.first_of_each(found, ["source"], M.passage_key(F.col("snippet")), ["doc_id"])
    return scan.top(fresh, ["source"], ["doc_id"]).select("source", F.col("place").cast("bigint").alias("place"), "doc_id", "term")


def uncovered_languages(spark: SparkSession, folder: str) -> DataFrame:
    return scan.uncovered(_doc(spark, folder), M.matcher(TERMS))


def scan_accounting(spark: SparkSession, folder: str) -> DataFrame:
    return scan.accounting(_doc(spark, folder), M.matcher(TERMS), F.length(F.coalesce("text", F.lit(""))) > 0)


def scan_tenders(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of tenders: their criteria first, then the texts of their documents."""
    criteria = read(spark, folder, "award_criteria", spread=True).filter(F.length("description") > 0)
    first = criteria.select("publication_number", F.col("crit_row").alias("seq"), F.upper(F.substring("lang", 1, 2)).alias("lang"), F.col("description").alias("text"))
    rest = _doc(spark, folder).filter((F.length("text") > 0) & F.col("publication_number").isNotNull())
    texts = rest.select("publication_number", F.lit(2).alias("tier"), F.col("doc_id").alias("seq"), "lang", "text")
    found = scan.notices(first, texts, M.matcher(TERMS), "publication_number")
    return found.select("publication_number", F.col("tier").cast("bigint").alias("tier"), "seq", "term", F.col("place").cast("bigint").alias("place"))


def whitespace_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(spark, folder).select("doc_id", M.collapse(F.col("text")).alias("text"))


def dehyphenate(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(spark, folder).select("doc_id", M.dehyphenate(F.col("text")).alias("text"))


def truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(spark, folder).select("doc_id", M.truncate(F.col("text"), 500).alias("text"))


def text_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = _doc(spark, folder).filter(F.col("publication_number").isNotNull())
    found = W.text_budget(rows, ["publication_number"], "doc_id", "text", 2000, 6000)
    return found.select("publication_number", "doc_id", F.length("given").cast("bigint").alias("given"), "withheld", "truncated")


# --- selection ------------------------------------------------------------------------------


def search_page(spark: SparkSession, folder: str) -> DataFrame:
    filters = S.Filters(country=["ita", "fra"], cpv=CODES, published_from="2024-06-01", published_to="2026/06/30")
    _, predicate = S.compile_filters(filters)
    found = read(spark, folder, "notices").filter(predicate)
    page = found.orderBy(S.day_key(F.col("publication_date")).desc_nulls_last(), "publication_number", "notice_row").offset(20).limit(20)
    return page.select("notice_row", "publication_number", "title", "buyer_country", F.left("publication_date", F.lit(10)).alias("published"))


def search_expert(spark: SparkSession, folder: str) -> DataFrame:
    query = '(classification-cpv IN (33141230 90910010) OR classification-cpv=45*) AND buyer-country=ITA AND FT ~ ("durata")'
    return read(spark, folder, "notices").filter(S.parse(query)).select("notice_row", "publication_number")


def search_count(spark: SparkSession, folder: str) -> DataFrame:
    _, predicate = S.compile_filters(S.Filters(cpv=CODES, notice_type="cn-standard", keywords="durata"))
    return read(spark, folder, "notices").filter(predicate).groupBy("buyer_country").agg(F.count("*").alias("found"))


def get_notices(spark: SparkSession, folder: str) -> DataFrame:
    return S.get_many(read(spark, folder, "notices"), ["10000003-2024", "10000013-2025", "99999999-2099"]).select("notice_row", "publication_number", "title")


def notice_summary(spark: SparkSession, folder: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return read(spark, folder, "notices").select(
        "notice_row",
        "publication_number",
        F.array_join(F.array_distinct("cpv"), ", ").alias("cpv"),
        F.left("publication_date", F.lit(10)).alias("published"),
        F.array_join(F.array_distinct("place_of_performance"), ", ").alias("places"),
        blank("winner_name").alias("winner"),
        F.coalesce(F.nullif("ted_url", F.lit("")), F.concat(F.lit("https://journal.example/en/notice/-/detail/"), "publication_number")).alias("url"),
    )


def criteria_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria of each tender, the same row once, with the text they are matched by."""
    rows = read(spark, folder, "award_criteria")
    same = ["publication_number", "type", "name", "description", "weight", "lang"]
    return rows.groupBy(*same).agg(F.min("crit_row").alias("crit_row")).select(
        "crit_row", "publication_number", F.trim(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))).alias("text"), F.coalesce(F.nullif(F.trim("weight"), F.lit("")), F.lit("-")).alias("weight")
    )


def buyers_by_role(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "organizations").filter(F.arrays_overlap("roles", F.array(F.lit("buyer"))))
    return rows.groupBy("country").agg(F.count("*").alias("buyers"), F.count_distinct("company_id").alias("codes"))


def dossier_links(spark: SparkSession, folder: str) -> DataFrame:
    """The best link to each dossier's documents: documents, then submission, then profile."""
    rank = lambda r: F.when(r == "tender-documents", 0).when(r == "submission", 1).when(r == "buyer-profile", 2).otherwise(9)
    links = read(spark, folder, "dossiers").select("dossier_id", F.posexplode("links").alias("seq", "link"))
    kept, _ = W.ranked_cap(links, ["dossier_id"], rank(F.col("link.role")), "seq", 1)
    return kept.select("dossier_id", F.col("link.url").alias("url"), F.col("link.role").alias("role"))


# --- links and files ------------------------------------------------------------------------


def document_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lots").filter(F.col("documents_url").isNotNull())
    url = F.col("documents_url")
    return rows.select("lot_row", W.host(url).alias("host"), W.site(url).alias("site"), W.path(url).alias("path"), W.looks_like_document(url).alias("is_document"))


def human_checks(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(W.human_check(F.lit("text/html"), F.col("text")).isNotNull(), "captcha").otherwise("fetched")
    return _doc(spark, folder).filter(F.col("text").isNotNull()).groupBy(status.alias("status")).agg(F.count("*").alias("pages"))


def ranked_lots(spark: SparkSession, folder: str) -> DataFrame:
    """The three lots of each tender whose titles rank first."""
    rows = read(spark, folder, "lots").filter(F.col("title").isNotNull())
    kept, _ = W.ranked_cap(rows, ["publication_number"], W.name_rank(F.col("title")), "lot_row", 3)
    return kept.select("publication_number", "lot_row", F.col("rank").cast("bigint").alias("rank"), F.col("place").cast("bigint").alias("place"))


def skipped_lots(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lots").filter(F.col("title").isNotNull())
    return W.ranked_cap(rows, ["publication_number"], W.name_rank(F.col("title")), "lot_row", 3)[1]


def unseen_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Submission addresses that are no document address, each once with its first lot."""
    lots = read(spark, folder, "lots")
    new = lots.filter(F.col("submission_url").isNotNull()).join(lots.select(F.col("documents_url").alias("submission_url")).distinct(), "submission_url", "left_anti")
    return new.groupBy(F.col("submission_url").alias("url")).agg(F.min("lot_row").alias("lot_row"))


def cache_eviction(spark: SparkSession, folder: str) -> DataFrame:
    return W.evict(_doc(spark, folder).filter(F.col("n_chars") > 0), "n_chars", "fetched_at", 200_000, key="doc_id").select("doc_id", "n_chars")


# --- contracts ------------------------------------------------------------------------------


def contract_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = K.lookup(read(spark, folder, "contracts"), ["01935680007", "84311390003"], ["4523", "3414"], limit=50)
    return found.select("record_id", "cig", "cod_cpv", "importo_lotto")


def lookup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return K.lookup(read(spark, folder, "contracts"), ["01935680007", "84311390003"], ["4523", "3414"], limit=50)[1]


def lenient_numbers(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "contracts")
    return rows.select("record_id", K.lenient(F.col("importo_lotto")).alias("lot"), K.lenient(F.col("importo_complessivo_gara")).alias("whole"))


def contract_values(spark: SparkSession, folder: str) -> DataFrame:
    """Cancelled contracts with the other contracts of the same buyer and amount, to the cent."""
    records = read(spark, folder, "contracts")
    value = K.lenient(F.col("importo_lotto"))
    asked = records.filter("stato = 'CANCELLATO'").select(F.col("record_id").alias("asked_id"), F.col("cf_amministrazione_appaltante").alias("buyer_code"), value.alias("value")).filter("value > 0")
    return K.join_values(asked, records).filter("asked_id <> record_id").select("asked_id", "record_id")


def stacked_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and rows without a name in the three tables that name bodies."""
    parts = [("notices", "buyer_name"), ("organizations", "name"), ("contracts", "denominazione_amministrazione_appaltante")]
    whole = scan.stacked([read(spark, folder, t).select(F.col(c).alias("name")) for t, c in parts])
    return whole.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("rows"), F.count_if(F.col("name").isNull()).alias("nameless"))


def queries() -> dict:
    own = [
        term_find_by_lang, term_find_anywhere, near_pairs, regex_find, passage_dedupe, top_matches_per_source, uncovered_languages,
        scan_accounting, scan_tenders, whitespace_collapse, dehyphenate, truncate_text, text_budget, search_page, search_expert,
        search_count, get_notices, notice_summary, criteria_grid, buyers_by_role, dossier_links, document_links, human_checks,
        ranked_lots, skipped_lots, unseen_urls, cache_eviction, contract_lookup, lookup_stats, lenient_numbers, contract_values, stacked_counts,
    ]
    return {f.__name__: f for f in own}


def _sql_cpv(exact: list[str], prefixes: list[str]) -> str:
    tests = [f"x IN ({', '.join(repr(e) for e in exact)})"] if exact else []
    tests += [f"starts_with(x, '{p}')" for p in prefixes]
    return f"len(list_filter(cpv, lambda x: {' OR '.join(tests)})) > 0"


def oracle_sql() -> dict[str, str]:
    spec, any_spec = M.Spec(TERMS), M.Spec({**TERMS, M.ANY: ANYWHERE})
    near = M.Spec({}, NEAR_A, NEAR_B)
    found = f"(SELECT *, {_sql_snippet()} AS snippet FROM {_sql_found(spec)})"
    fresh = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, {_KEY} ORDER BY doc_id) AS n FROM {found}) WHERE n = 1)"
    covered = "l = '' OR l IN ('DE', 'EN', 'IT')"
    start, term = _sql_by_language(spec, lambda n: _sql_hit(M._of(spec.terms, n)))
    hit = f"SELECT *, {start} AS start, {term} AS term FROM (SELECT *, upper(trim(coalesce(lang, ''))) AS l, {_LOW} AS low FROM {{}})"
    both = f"""(SELECT publication_number, 1 AS tier, crit_row AS seq, upper(substr(lang, 1, 2)) AS lang, description AS text FROM award_criteria WHERE length(description) > 0
        UNION ALL SELECT publication_number, 2, doc_id, lang, text FROM documents WHERE length(text) > 0 AND publication_number IS NOT NULL)"""
    exact, prefixes = S.cpv_tokens(CODES)
    rank = "CASE " + " ".join(f"WHEN strpos(lower(regexp_extract(rtrim(title, '/'), '([^/]*)$', 1)), '{n}') > 0 THEN {i}" for i, n in enumerate(W.NAME_ORDER)) + f" ELSE {len(W.NAME_ORDER)} END"
    path = r"regexp_extract(documents_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    host = r"lower(regexp_extract(documents_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    probe = rf"lower({path} || '?' || regexp_extract(documents_url, '\?([^#]*)', 1))"
    extension = rf"lower(regexp_extract(regexp_extract(rtrim({path}, '/'), '([^/]*)$', 1), '(\.[^.]*)$', 1))"
    number = lambda c: f"CASE WHEN {c} IS NULL OR trim({c}) IN ('', 'null') THEN 0.0 ELSE TRY_CAST(trim({c}) AS DOUBLE) END"
    lot, whole = number("importo_lotto"), number("importo_complessivo_gara")
    own = "cf_amministrazione_appaltante IN ('01935680007', '84311390003')"
    fits = f"({own} AND {lot} IS NOT NULL AND {whole} IS NOT NULL AND (starts_with(cod_cpv, '4523') OR starts_with(cod_cpv, '3414')))"
    day = "replace(left(publication_date, 10), '-', '')"
    cut = "left(coalesce(text, ''), 2000)"
    spent = f"coalesce(sum(length({cut})) OVER (PARTITION BY publication_number ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    checks = " OR ".join(f"strpos(lower(substr(text, 1, 65536)), '{m}') > 0" for m, _ in W.HUMAN_CHECKS)
    return {
        "term_find_by_lang": f"SELECT doc_id, lang, term, start, snippet FROM {found}",
        "term_find_anywhere": f"SELECT doc_id, lang, term, start FROM {_sql_found(any_spec)}",
        "near_pairs": f"SELECT doc_id, lang, term, start FROM {_sql_found(near, pairs=True)}",
        "regex_find": f"SELECT doc_id, regexp_extract(text, '(?i){REGEX}', 0) AS term FROM documents WHERE regexp_matches(text, '(?i){REGEX}')",
        "passage_dedupe": f"SELECT source, doc_id, term FROM {fresh}",
        "top_matches_per_source": f"SELECT source, place, doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM {fresh}) WHERE place <= 12",
        "uncovered_languages": f"SELECT l AS language, count(*) AS texts FROM (SELECT {_LANG} AS l FROM documents) WHERE NOT ({covered}) GROUP BY l",
        "scan_accounting": f"""SELECT count(*) AS scanned, count(*) FILTER (coalesce(length(text), 0) = 0) AS unreadable,
            count(*) FILTER (coalesce(length(text), 0) > 0 AND NOT ({covered})) AS uncovered, count(*) FILTER (coalesce(length(text), 0) > 0 AND start IS NOT NULL) AS matched
            FROM ({hit.format("documents")})""",
        "scan_tenders": f"""WITH hits AS (SELECT *, {_sql_snippet()} AS snippet FROM ({hit.format(both)}) WHERE start IS NOT NULL),
            keyed AS (SELECT *, {_KEY} AS k FROM hits),
            firsts AS (SELECT * EXCLUDE (n, p) FROM (SELECT *, row_number() OVER (PARTITION BY publication_number ORDER BY seq) AS p FROM (SELECT *, row_number() OVER (PARTITION BY publication_number, k ORDER BY seq) AS n FROM keyed WHERE tier = 1) WHERE n = 1) WHERE p <= 12),
            rest AS (SELECT * FROM keyed r WHERE tier = 2 AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.publication_number = r.publication_number AND contains(lower(f.text), lower(r.text)))),
            united AS (SELECT *, row_number() OVER (PARTITION BY publication_number, k ORDER BY tier, seq) AS n FROM (SELECT * FROM firsts UNION ALL SELECT * FROM rest))
            SELECT publication_number, tier::BIGINT AS tier, seq, term, place FROM (SELECT *, row_number() OVER (PARTITION BY publication_number ORDER BY tier, seq) AS place FROM united WHERE n = 1) WHERE place <= 12""",
        "whitespace_collapse": f"SELECT doc_id, {_sql_strip(f"regexp_replace(text, '{_SPACE}', ' ', 'g')")} AS text FROM documents",
        "dehyphenate": r"SELECT doc_id, regexp_replace(replace(text, chr(173), ''), '(\p{L})-[ \t]*[\r\n]+[ \t]*(\p{L})', '\1\2', 'g') AS text FROM documents",
        "truncate_text": f"SELECT doc_id, CASE WHEN length(text) > 500 THEN {_sql_strip('left(text, 500)')} || '…' ELSE text END AS text FROM documents",
        "text_budget": f"""SELECT publication_number, doc_id, length(left(cut, greatest(6000 - spent, 0)))::BIGINT AS given, length(cut) > 0 AND 6000 - spent <= 0 AS withheld,
            length(left(cut, greatest(6000 - spent, 0))) < length(coalesce(text, '')) AS truncated
            FROM (SELECT publication_number, doc_id, text, {cut} AS cut, ({spent})::BIGINT AS spent FROM documents WHERE publication_number IS NOT NULL)""",
        "search_page": f"""SELECT notice_row, publication_number, title, buyer_country, left(publication_date, 10) AS published FROM notices
            WHERE {_sql_cpv(exact, prefixes)} AND buyer_country IN ('ITA', 'FRA') AND {day} >= '20240601' AND {day} <= '20260630'
            ORDER BY {day} DESC NULLS LAST, publication_number, notice_row LIMIT 20 OFFSET 20""",
        "search_expert": f"SELECT notice_row, publication_number FROM notices WHERE {_sql_cpv(['33141230', '90910010'], ['45'])} AND buyer_country = 'ITA' AND contains(lower(title), 'durata')",
        "search_count": f"SELECT buyer_country, count(*) AS found FROM notices WHERE {_sql_cpv(exact, prefixes)} AND notice_type = 'cn-standard' AND contains(lower(title), 'durata') GROUP BY buyer_country",
        "get_notices": "SELECT notice_row, publication_number, title FROM notices WHERE publication_number IN ('10000003-2024', '10000013-2025', '99999999-2099')",
        "notice_summary": """SELECT notice_row, publication_number, array_to_string(list_filter(cpv, lambda x, i: list_position(cpv, x) = i), ', ') AS cpv, left(publication_date, 10) AS published,
            array_to_string(list_filter(place_of_performance, lambda x, i: list_position(place_of_performance, x) = i), ', ') AS places, coalesce(winner_name, '') AS winner,
            coalesce(nullif(ted_url, ''), 'https://journal.example/en/notice/-/detail/' || publication_number) AS url FROM notices""",
        "criteria_grid": """SELECT min(crit_row) AS crit_row, publication_number, trim(coalesce(name, '') || ' ' || coalesce(description, '')) AS text, coalesce(nullif(trim(weight), ''), '-') AS weight
            FROM award_criteria GROUP BY publication_number, type, name, description, weight, lang""",
        "buyers_by_role": "SELECT country, count(*) AS buyers, count(DISTINCT company_id) AS codes FROM organizations WHERE list_contains(roles, 'buyer') GROUP BY country",
        "dossier_links": """SELECT dossier_id, url, role FROM (SELECT dossier_id, link.url AS url, link.role AS role, row_number() OVER (PARTITION BY dossier_id ORDER BY
            CASE link.role WHEN 'tender-documents' THEN 0 WHEN 'submission' THEN 1 WHEN 'buyer-profile' THEN 2 ELSE 9 END, seq) AS n
            FROM (SELECT dossier_id, unnest(links) AS link, generate_subscripts(links, 1) AS seq FROM dossiers)) WHERE n = 1""",
        "document_links": rf"""SELECT lot_row, {host} AS host, CASE WHEN len(string_split({host}, '.')) > 3 THEN array_to_string(string_split({host}, '.')[-3:], '.') ELSE {host} END AS site, {path} AS path,
            {extension} IN ({", ".join(repr(e) for e in W.EXTENSIONS)}) OR {" OR ".join(f"strpos({probe}, '{h}') > 0" for h in W.HINTS)} AS is_document FROM lots WHERE documents_url IS NOT NULL""",
        "human_checks": f"SELECT CASE WHEN {checks} THEN 'captcha' ELSE 'fetched' END AS status, count(*) AS pages FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "ranked_lots": f"SELECT publication_number, lot_row, rank::BIGINT AS rank, place FROM (SELECT *, row_number() OVER (PARTITION BY publication_number ORDER BY rank, lot_row) AS place FROM (SELECT *, {rank} AS rank FROM lots WHERE title IS NOT NULL)) WHERE place <= 3",
        "skipped_lots": "SELECT publication_number, count(*) - 3 AS skipped FROM lots WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 3",
        "unseen_urls": "SELECT submission_url AS url, min(lot_row) AS lot_row FROM lots WHERE submission_url IS NOT NULL AND submission_url NOT IN (SELECT documents_url FROM lots WHERE documents_url IS NOT NULL) GROUP BY 1",
        "cache_eviction": """SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER () AS whole, coalesce(sum(n_chars) OVER (ORDER BY fetched_at, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM documents WHERE n_chars > 0) WHERE whole > 200000 AND whole - before > 0.8 * 200000""",
        "contract_lookup": f"SELECT record_id, cig, cod_cpv, importo_lotto FROM contracts WHERE {fits} ORDER BY cig, record_id LIMIT 50",
        "lookup_stats": f"""SELECT count(*) AS scanned, count(*) FILTER ({own}) AS candidates, count(*) FILTER ({own} AND ({lot} IS NULL OR {whole} IS NULL)) AS malformed,
            count(*) FILTER ({fits}) AS matched, count(*) FILTER ({fits}) > 50 AS limit_hit FROM contracts""",
        "lenient_numbers": f"SELECT record_id, {lot} AS lot, {whole} AS whole FROM contracts",
        "contract_values": f"""SELECT asked_id, record_id FROM (SELECT record_id AS asked_id, cf_amministrazione_appaltante AS buyer_code, {lot} AS value FROM contracts WHERE stato = 'CANCELLATO') a
            JOIN contracts c ON c.cf_amministrazione_appaltante = a.buyer_code WHERE a.value > 0 AND asked_id <> record_id AND (abs(({lot}) - a.value) < 0.01 OR abs(({whole}) - a.value) < 0.01)""",
        "stacked_counts": "SELECT part::BIGINT AS part, count(*) AS rows, count(*) FILTER (name IS NULL) AS nameless FROM (SELECT 0 AS part, buyer_name AS name FROM notices UNION ALL SELECT 1, name FROM organizations UNION ALL SELECT 2, denominazione_amministrazione_appaltante FROM contracts) GROUP BY part",
    }
