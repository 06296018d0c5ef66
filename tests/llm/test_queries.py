"""The registered corpus queries and the pipeline over the smallest tables."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from larkspur.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DIR)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    key = lambda r: [(x is None, x) for x in r]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == sorted(want.select(*order).fetchall(), key=key)


def test_line_dedup_matches_its_sql_where_lines_go(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.sql(queries.ORACLES["op4_line_dedup"])
    rows = [tuple(r[c] for c in want.columns) for r in queries.op4_line_dedup(spark, path).collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
    assert sum(r[want.columns.index("n_dropped")] for r in rows) > 0


def test_pipeline_drops_lines_of_small_hosts(spark):
    rows = [(k, f"menu\nown {k}", "en", "five", 10) for k in range(5)] + [(10 + k, f"menu\nown {k}", "en", "two", 10) for k in range(2)] + [(20 + k, f" menu\nown {k}", "en", None, 11) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, frame, DIR).collect()}
    gone = {k: (f"own {k % 10}", 5) for k in (0, 1, 2, 3, 4, 20, 21, 22)}
    assert got == gone | {10 + k: (f"menu\nown {k}", 10) for k in range(2)}


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    packed = corpus_pipeline.run(spark, DIR)
    assert packed.select("doc_id").distinct().count() == counts[-1]
