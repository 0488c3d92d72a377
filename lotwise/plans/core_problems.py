"""The queries of the general data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import quantities, timestamps
from lotwise.operators.nested import Child, fields, shred
from lotwise.sources.tables import read


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """p1_found(src, row_id, qty): every row that states a quantity, in its canonical unit."""
    rates, countries = read(spark, folder, "fx_rates"), read(spark, folder, "country_codes")
    notices = read(spark, folder, "notices").select("notice_row", "publication_number", "buyer_country", "total_value")
    country = notices.groupBy("publication_number").agg(F.min("buyer_country").alias("buyer_country"))
    lots = (
        read(spark, folder, "lots")
        .select("lot_row", "publication_number", "value", "currency")
        .withColumn("money", quantities.parsed_money(F.col("value"), F.col("currency")))
        .filter(F.col("money.amount").isNotNull())
        .join(country, "publication_number", "left")
    )
    totals = notices.withColumn("money", quantities.parsed_money(F.col("total_value")))
    criteria = read(spark, folder, "award_criteria").select("crit_row", "publication_number", "lot_id", "seq", "weight")
    parts = [
        ("notices", "notice_row", quantities.in_euros(totals, "money", "buyer_country", countries, rates)),
        ("lots", "lot_row", quantities.in_euros(lots, "money", "buyer_country", countries, rates)),
        ("award_criteria", "crit_row", quantities.in_basis_points(criteria, "weight", ["publication_number", "lot_id"], "seq")),
    ]
    out = None
    for src, key, df in parts:
        part = df.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "qty")
        out = part if out is None else out.unionByName(part)
    return out


#: What a reading costs that the sources' rules exclude: all-numeric dates have the day first unless they begin
#: with the year, and times without a zone are local. Saying nothing costs less than breaking a rule, and
#: either more than all that a record can spare its neighbours (two changes of format, two jumps back).
BROKEN_RULE, NOTHING = 12.0, 6.0
UNLIKELY = {"mdy": BROKEN_RULE, "y2md": BROKEN_RULE, "alt-": BROKEN_RULE}


def _deadlines(spark: SparkSession, folder: str) -> DataFrame:
    """(src, row_id, zone, readings) of all deadlines; ``zone`` is the local one of the buyer."""
    zones = read(spark, folder, "country_codes").groupBy("country").agg(F.min("zone_name").alias("zone"))
    notices = read(spark, folder, "notices").select("notice_row", "publication_number", "buyer_country", "deadline")
    country = notices.groupBy("publication_number").agg(F.min("buyer_country").alias("buyer_country"))
    lots = read(spark, folder, "lots").select("lot_row", "publication_number", "deadline_date", "deadline_time")
    contracts = read(spark, folder, "contracts").select("record_id", "data_scadenza_offerta")
    parts = [
        notices.select(F.lit("notices").alias("src"), F.col("notice_row").alias("row_id"), "buyer_country", timestamps.readings(F.col("deadline"), unlikely=UNLIKELY).alias("r")),
        lots.select("lot_row", "publication_number", timestamps.readings(F.col("deadline_date"), F.col("deadline_time"), unlikely=UNLIKELY).alias("r"))
        .join(country, "publication_number", "left")
        .select(F.lit("lots").alias("src"), F.col("lot_row").alias("row_id"), "buyer_country", "r"),
        contracts.select(F.lit("contracts").alias("src"), F.col("record_id").alias("row_id"), F.lit("ITA").alias("buyer_country"), timestamps.readings(F.col("data_scadenza_offerta"), unlikely=UNLIKELY).alias("r")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.join(F.broadcast(zones), F.col("buyer_country") == F.col("country"), "left").select("src", "row_id", "zone", "r")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """p2_found(src, row_id, utc_seconds): every row that fixes an instant."""
    rows = _deadlines(spark, folder).select("src", "row_id", timestamps.as_instants(F.col("r"), F.col("zone"), BROKEN_RULE).alias("c"))
    keys = {"notices": "notice_row", "lots": "lot_row", "contracts": "record_id"}
    ends = [read(spark, folder, t).agg(F.min(k), F.max(k)).first() for t, k in keys.items()]  # told by the files' statistics
    span = max((last - first for first, last in ends if first is not None), default=0)
    chosen = timestamps.choose(rows, "src", "row_id", "c", none=NOTHING, span=span)
    return chosen.select("src", F.col("pos").alias("row_id"), F.col("at").alias("utc_seconds"))


DOSSIER_CHILDREN = [
    Child("organization", "organizations"),
    Child("role", "roles", "organization", scalars=True),
    Child("lot", "lots"),
    Child("criterion", "criteria", "lot"),
]
#: What a reader looks for in each kind of record.
DOSSIER_FIELDS = {
    "organization": ["id", "name", "company_id", "roles", "email", "phone", "website", "city", "country"],
    "lot": ["id", "title", "value", "currency", "cpv", "deadline_date", "deadline_time", "documents_url", "submission_url"],
    "criterion": ["type", "name", "description", "weight", "lang"],
    "link": ["url", "role", "note"],
}


def _dossier_children(spark: SparkSession, folder: str, raw: bool, spec: list[Child] | None = None) -> DataFrame:
    spec = spec or DOSSIER_CHILDREN
    roots = [c.key for c in spec if c.parent is None]
    typed = read(spark, folder, "dossiers").select(F.lit("dossiers").alias("src"), "dossier_id", F.to_json(F.struct(*roots), {"ignoreNullFields": "false"}).alias("body"))
    text = read(spark, folder, "dossier_json").select(F.lit("dossier_json").alias("src"), "dossier_id", "body")
    return shred(typed.unionByName(text), ["src", "dossier_id"], "body", spec, raw)


def dossier_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The flat tables of all dossiers, by kind: their keys (src, dossier_id, parent_pos, pos) and all fields as text.

    Lists among the fields (roles, cpv) are JSON text. The records are found once: store the frame they
    share before several tables are written.
    """
    found = _dossier_children(spark, folder, True, [*DOSSIER_CHILDREN, Child("link", "links")])
    return {kind: found.filter(F.col("child") == kind).select("src", "dossier_id", "parent_pos", "pos", *fields(F.col("raw"), names)) for kind, names in DOSSIER_FIELDS.items()}


def _typed_table(kind: str):
    lists = ("roles", "cpv")

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = dossier_tables(spark, folder)[kind].filter("src = 'dossiers'")
        value = lambda c: F.array_join(F.from_json(c, "array<string>"), "|").alias(c) if c in lists else F.col(c)
        place = [F.col(c).cast("bigint").alias(c) for c in ("parent_pos", "pos")]
        return rows.select("dossier_id", *place, *[value(c) for c in DOSSIER_FIELDS[kind]])

    query.__name__ = "p3_criteria" if kind == "criterion" else f"p3_{kind}s"
    query.__doc__ = f"The flat table of the {kind}s of the typed dossiers, with their parents."
    return query


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found(src, dossier_id, child, parent_pos, pos): every child record of every dossier."""
    return _dossier_children(spark, folder, raw=False)


def p3_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The child records with the fields a reader joins on, whatever their keys' spelling."""
    found = _dossier_children(spark, folder, raw=True)
    field = lambda *names: F.coalesce(*[F.get_json_object("raw", f"$.{n}") for n in names])
    record = F.col("child") != "role"
    return found.select(
        "src",
        "dossier_id",
        "child",
        "parent_pos",
        "pos",
        F.when(record, field("id")).alias("id"),
        F.when(record, field("name", "title")).otherwise(F.col("raw")).alias("label"),
        F.when(F.col("child") == "organization", field("company_id", "companyId")).alias("company_id"),
        F.when(F.col("child") == "lot", field("value")).alias("value"),
        F.when(F.col("child") == "criterion", field("weight")).alias("weight"),
    )


def queries() -> dict:
    tables = [_typed_table(kind) for kind in ("organization", "lot", "criterion", "link")]
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_rows": p3_rows, **{f.__name__: f for f in tables}}


def oracle_sql() -> dict[str, str]:
    def of(source: str, kind: str, parent: str = "0") -> str:
        value = lambda c: f"array_to_string(x.{c}, '|') AS {c}" if c in ("roles", "cpv") else f"x.{c} AS {c}"
        return f"SELECT dossier_id, {parent}::BIGINT AS parent_pos, k::BIGINT AS pos, {', '.join(map(value, DOSSIER_FIELDS[kind]))} FROM ({source}) WHERE x IS NOT NULL"

    each = lambda c: f"SELECT dossier_id, unnest({c}) AS x, generate_subscripts({c}, 1) AS k FROM dossiers"
    criteria = f"SELECT dossier_id, k AS parent, unnest(x.criteria) AS x, generate_subscripts(x.criteria, 1) AS k FROM ({each('lots')}) WHERE x IS NOT NULL"
    return {
        "p3_organizations": of(each("organizations"), "organization"),
        "p3_lots": of(each("lots"), "lot"),
        "p3_criteria": of(criteria, "criterion", "parent"),
        "p3_links": of(each("links"), "link"),
    }
