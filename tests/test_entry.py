import os
import subprocess
import sys

import duckdb

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "session_id" in df.columns


def test_every_library_query_has_sql():
    from cartwise.plans.catalog import QUERIES
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(o)


def test_entry_works_without_the_optional_queries():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as E; "
            "assert set(E.queries()) == set(E.QUERIES) and set(E.oracle_sql()) == set(E.QUERIES)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(E.__file__))


def test_oracle_agreement_small(spark):
    con = duckdb.connect()
    for t in ("events", "part", "orders", "labels", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in ("sessionize_30m", "session_features_12h", "training_frame", "top_k_per_session",
                 "items_wide", "category_conversion"):
        a = q[name](spark, SMALL).toPandas()
        b = con.sql(o[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        ra = sorted(map(tuple, a[cols].astype(str).values.tolist()))
        rb = sorted(map(tuple, b[cols].astype(str).values.tolist()))
        assert ra == rb, name
