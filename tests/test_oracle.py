"""Each query against its SQL in DuckDB, and the driver's contract."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vestry.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(oracle.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_salvage_full(spark, sf_dir):
    rows = queries.llm_salvage_full(spark, sf_dir).collect()
    kinds = {r["record_type"] for r in rows}
    assert kinds == {"birth", "death", "marriage"} and all(r["rec_id"] % 4 != 2 for r in rows)
    assert all(r["average"] == 0.5 for r in rows if r["record_type"] == "birth")


def test_image_pipeline(spark, sf_dir):
    rows = queries.image_pipeline(spark, sf_dir).collect()
    assert len(rows) == 10
    steps = "resize(80),color_normalize,illumination_normalize,mild_denoise,deskew_robust,contrast(clip=2.0),border_removal(w=2)"
    assert {r["steps"] for r in rows} == {steps} and all(44 <= r["height"] <= 90 for r in rows)


def test_region_steps(spark, sf_dir):
    rows = queries.region_steps(spark, sf_dir).collect()
    assert len(rows) == 70 and {(r["least"], r["most"]) for r in rows if r["region"] in ("printed_text", "signature")} == {(0, 255)}


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark, sf_dir):
    plan = queries.block_types(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan  # columns that aren't asked for aren't read
    plan = queries.relationships(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
