import importlib

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_run_without_llm():
    plans = importlib.import_module("sievebench.plans")
    assert not any(k.startswith(("p1_", "p2_", "p3_", "p5_")) for k in plans.queries())


@pytest.mark.parametrize("name", ["op_a1_proportions", "op_j1_top_chunks", "op_h1_content_address", "op_s8_stratified_split", "flagship_demand_weighted_ndcg"])
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("production_queries", "chunks", "seeds", "qrels", "vector_store", "documents"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    as_text = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert as_text(got) == as_text(want)
