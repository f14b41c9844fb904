"""Every panel and model query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidewell.plans import audit_queries, inference_queries, model_queries, panel_queries, run_queries

DIR = "/root/testdata/sf0.001"
SQL = panel_queries.SQL | model_queries.SQL | audit_queries.SQL | run_queries.SQL | inference_queries.SQL
QUERIES = panel_queries.QUERIES | model_queries.QUERIES | audit_queries.QUERIES | run_queries.QUERIES | inference_queries.QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toArrow()
    want = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    cols = ", ".join(f'"{c}"' for c in got.column_names)
    duck.register("got_", got)
    duck.register("want_", want)
    for a, b in (("got_", "want_"), ("want_", "got_")):
        assert duck.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []


def test_every_query_is_registered_and_imports_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(set(e.oracle_sql()) - set(e.queries())))"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert said.stdout.strip() == "0", said.stderr


def test_bootstrap_draws_as_often_as_the_policy(spark):
    assert {r.reps for n in ("bootstrap_dca_ci", "bootstrap_ap_brier_ci") for r in QUERIES[n](spark, DIR).select("reps").collect()} == {300}
