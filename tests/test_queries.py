"""Every registered query of the engine against DuckDB, on the smallest tables, and the shape of some plans."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import ferrule.plans.api_queries  # noqa: F401
import ferrule.plans.code_queries  # noqa: F401  registers with it the other queries
import ferrule.plans.escape_queries  # noqa: F401
import ferrule.plans.graph_queries  # noqa: F401
import ferrule.plans.image_queries  # noqa: F401
import ferrule.plans.page_queries  # noqa: F401
import ferrule.plans.string_queries  # noqa: F401
import ferrule.plans.symbol_queries  # noqa: F401
from ferrule.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def normal(frame) -> list[tuple]:
    def value(v):
        return "NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(value, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["range_join_areas", "interval_overlap", "tailcalls", "block_locator"])
def test_no_nested_loops(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_scan_reads_needed_columns(spark, sf):
    text = plan(QUERIES["leaf_functions"](spark, sf))
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_reports_are_parsed_once(spark, sf):
    text = plan(QUERIES["report_statistics"](spark, sf))
    assert "from_json" not in text and "to_json" not in text


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
