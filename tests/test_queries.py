import os

import duckdb
import pytest

import __spark_entry__ as entry
from lotwise.streaming import ingest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
CORE = {n: sql for m in entry._MODULES if "llm" not in m.__name__ for n, sql in getattr(m, "oracle_sql", dict)().items()}


@needs_data
@pytest.mark.parametrize("name", sorted(CORE))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = c.execute(CORE[name])
    assert sorted(d[0] for d in rows.description) == columns
    at = [[d[0] for d in rows.description].index(x) for x in columns]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(norm(r[i]) for i in at) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(norm(r[x]) for x in columns) for r in df.collect()), key=repr) == want


@needs_data
def test_entry_and_found(spark):
    assert entry.entry(spark).columns == ["src", "row_id", "qty"]
    found = entry.queries()["p3_found"](spark, DATA)
    assert found.count() == found.distinct().count() > 0
    c = duckdb.connect()
    want = c.execute(f"select sum(len(organizations)), sum(len(lots)) from '{DATA}/dossiers.parquet'").fetchone()
    got = found.filter("src = 'dossiers'").groupBy("child").count().collect()
    assert {r.child: r["count"] for r in got if r.child in ("organization", "lot")} == {"organization": want[0], "lot": want[1]}
    two = entry.queries()["p2_found"](spark, DATA)
    assert two.count() == two.select("src", "row_id").distinct().count() > 0


def test_append_new(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([("a", 1)], "key string, v int").schema
    for rows in ([("a", 1), ("a", 2), (None, 3)], [("a", 9), ("b", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.append_new(ingest.landing(spark, source, schema), "key", target, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(target).collect()) == ["a", "b"]
