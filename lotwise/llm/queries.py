"""The queries of the corpus and linkage problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import linking, mixing, names, neardup, packing, reading, tokens
from lotwise.operators import quantities
from lotwise.sources.tables import ensure_checkpoints, read


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents", spread=True).filter(F.length("text") >= 200).select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
    criteria = read(spark, folder, "award_criteria", spread=True).select(F.lit("award_criteria").alias("src"), F.col("crit_row").alias("id"), F.col("description").alias("text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return documents.unionByName(criteria.filter(words >= 20))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """p4_found(src, id_a, id_b): all pairs of texts that are versions of one another."""
    ensure_checkpoints(spark)
    return neardup.pairs(_texts(spark, folder))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each text with its class of exact copies and the number of classes it is linked to."""
    ensure_checkpoints(spark)
    return neardup.classes(_texts(spark, folder))


def _lot_records(spark: SparkSession, folder: str) -> DataFrame:
    """Lots of Italian buyers with the buyer's code and the value in euros."""
    notices = read(spark, folder, "notices").groupBy("publication_number").agg(F.min("buyer_country").alias("buyer_country")).filter("buyer_country = 'ITA'")
    buyers = read(spark, folder, "organizations").filter("org_id = 'ORG-0001'").groupBy("publication_number").agg(F.max("company_id").alias("code"))
    lots = read(spark, folder, "lots", spread=True).select("lot_row", "publication_number", "title", "value", "currency", "cpv", "deadline_date")
    here = lots.join(notices, "publication_number").join(buyers, "publication_number", "left")
    priced = here.withColumn("money", quantities.parsed_money(F.col("value"), F.col("currency")))
    rates = read(spark, folder, "fx_rates").select("currency", "eur_per_unit")
    unit = F.when(F.size("money.currencies") == 0, "EUR").otherwise(F.get("money.currencies", F.lit(0)))
    euros = priced.drop("currency").withColumn("currency", unit).join(F.broadcast(rates), "currency", "left")
    return euros.select(
        F.col("lot_row").alias("id"),
        "title",
        "code",
        (F.col("money.amount") * F.col("eur_per_unit")).alias("amount"),
        F.get("cpv", F.lit(0)).alias("cpv"),
        F.col("deadline_date").alias("date"),
    )


def _contract_records(spark: SparkSession, folder: str) -> DataFrame:
    contracts = read(spark, folder, "contracts", spread=True)
    return contracts.select(
        F.col("record_id").alias("id"),
        F.coalesce("oggetto_lotto", "oggetto_gara").alias("title"),
        F.col("cf_amministrazione_appaltante").alias("code"),
        quantities.parsed_money(F.col("importo_lotto"))["amount"].alias("amount"),
        F.col("cod_cpv").alias("cpv"),
        F.col("data_scadenza_offerta").alias("date"),
    )


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Lots and contracts that describe the same lot, with a confidence."""
    ensure_checkpoints(spark)
    found = linking.match(_lot_records(spark, folder), _contract_records(spark, folder))
    return found.select(F.col("id_a").alias("lot_row"), F.col("id_b").alias("record_id"), "confidence")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found(lot_row, record_id)."""
    return p5_matches(spark, folder).select("lot_row", "record_id")


def _typed_names(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("notices", "notice_row", "buyer_name"), ("organizations", "org_row", "name"), ("contracts", "record_id", "denominazione_amministrazione_appaltante")]
    out = None
    for src, key, col in parts:
        part = read(spark, folder, src).select(F.lit(src).alias("src"), F.col(key).alias("row_id"), F.col(col).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every row whose name means a registered buyer, with the similarity of the names."""
    ensure_checkpoints(spark)
    return names.link(_typed_names(spark, folder), "name", read(spark, folder, "buyer_register"), "buyer_id", "official_name", "city").drop("name")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """p6_found(src, row_id, buyer_id)."""
    return p6_links(spark, folder).select("src", "row_id", "buyer_id")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents", spread=True).select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"))


def p7_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document lies in containers of each capacity."""
    return packing.pack(_sizes(spark, folder), "doc_id", "tokens", read(spark, folder, "container_sizes"), "container_id", "capacity_tokens")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(p7_bins(spark, folder), read(spark, folder, "container_sizes"), "container_id", "capacity_tokens")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix in training order."""
    ensure_checkpoints(spark)
    return mixing.mix(_sizes(spark, folder).checkpoint(), "doc_id", "source", "tokens", read(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share each source has of each mix, beside its target."""
    return mixing.shares(p8_mix(spark, folder), read(spark, folder, "mix_targets"))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What has to hold for containers of each capacity: none too full, all tokens there, none divided that fits, little room left."""
    sizes = _sizes(spark, folder).persist()
    kinds = read(spark, folder, "container_sizes")
    placed = packing.pack(sizes, "doc_id", "tokens", kinds, "container_id", "capacity_tokens").persist()
    bins = placed.groupBy("container_id", "bin").agg(F.sum("tokens").alias("used")).join(F.broadcast(kinds), "container_id")
    full = bins.groupBy("container_id").agg((F.max(F.col("used") - F.col("capacity_tokens")) <= 0).alias("within"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum("capacity_tokens") > 0.93).alias("dense"))
    texts = placed.groupBy("container_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("size")).join(F.broadcast(kinds), "container_id")
    whole = texts.groupBy("container_id").agg((F.max(F.col("pieces") - F.ceil(F.col("size") / F.col("capacity_tokens"))) <= 0).alias("undivided"), F.count("*").alias("texts"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    return full.join(whole, "container_id").select("container_id", "within", "dense", "undivided", "texts", (F.col("tokens") == total).alias("complete"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What has to hold for each mix and source: its share within a document's reach, and no more copies than allowed."""
    targets = read(spark, folder, "mix_targets")
    found = mixing.shares(p8_mix(spark, folder), targets).join(targets.select("mix_id", "source", "max_repeats"), ["mix_id", "source"])
    return found.select("mix_id", "source", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.01).alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts have as many texts of their own wording."""
    rows = p4_classes(spark, folder)
    return rows.groupBy("src", "copies").agg(F.count("*").alias("texts"))


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The level of each document of at least 200 characters, with the two measures behind it."""
    return reading.levels(read(spark, folder, "documents", spread=True), "doc_id", "text", "lang", read(spark, folder, "level_samples"), min_chars=200)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """p9_found(doc_id, level)."""
    return p9_levels(spark, folder).select("doc_id", "level")


def queries() -> dict:
    own = [p4_found, p4_classes, p5_found, p5_matches, p6_found, p6_links, p7_bins, p7_fill, p8_mix, p8_shares, p9_found, p9_levels, p4_copies, p7_kept, p8_kept]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    words = r"array_to_string(regexp_extract_all(lower(replace(text, '-' || chr(10), '')), '[\p{L}\p{N}\p{M}]+'), ' ')"
    texts = """(SELECT 'documents' AS src, text FROM documents WHERE length(text) >= 200 UNION ALL
        SELECT 'award_criteria', description FROM award_criteria WHERE len(list_filter(regexp_split_to_array(description, '\\s+'), lambda w: w <> '')) >= 20)"""
    return {
        "p4_copies": f"SELECT src, copies, sum(copies)::BIGINT AS texts FROM (SELECT src, w, count(*) AS copies FROM (SELECT src, {words} AS w FROM {texts}) WHERE w <> '' GROUP BY src, w) GROUP BY src, copies",
        "p7_kept": "SELECT container_id, true AS within, true AS dense, true AS undivided, (SELECT count(*) FROM documents WHERE length(text) > 0) AS texts, true AS complete FROM container_sizes",
        "p8_kept": "SELECT mix_id, source, true AS met, true AS repeats_kept FROM mix_targets",
    }
