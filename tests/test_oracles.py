"""Every query against its SQL on the smallest tables, and plans that reach the scan."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 90


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(QUERIES["region_filter"](spark, SF))
    assert "PushedFilters: [" in text and "EqualTo(l_returnflag,A)" in text and "l_extendedprice" not in text


def test_ranks_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top_hits"](spark, SF))


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def compare(spark, tmp_path, name, tables):
    """A query and its SQL on tables made here, one file each."""
    c = duckdb.connect()
    for t, (select, columns) in tables.items():
        c.sql(f"CREATE TABLE {t} AS SELECT * FROM (VALUES {select}) v({columns})")
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLES[name]).df()
    assert len(want) and normal(got) == normal(want)


def test_large_keys_of_orders_are_read_to_the_end(spark, tmp_path):
    items = "(1::BIGINT, 5::BIGINT, 7::BIGINT, 1, 'A'), (4700000, 1199999, 59999, 2, 'R'), (4700000, 3, 8, 1, 'N'), (8999999, 12, 9, 7, 'A')"
    compare(spark, tmp_path, "domain_blocks", {"orders": ("(1::BIGINT), (4700000), (8999999)", "o_orderkey"), "lineitem": (items, "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag")})


def test_large_keys_of_hits_keep_their_order(spark, tmp_path):
    items = "(1::BIGINT, 150000::BIGINT, 1::BIGINT, 1, 'A'), (1, 10, 2, 2, 'R'), (2, 7, 5000, 1, 'N'), (2, 8, 1, 1, 'A')"
    compare(spark, tmp_path, "hit_table", {"lineitem": (items, "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag")})


def test_first_rows_of_one_line_number_are_those_of_the_first_file(spark, tmp_path):
    select = "SELECT k AS l_orderkey, {} AS l_suppkey, 5::BIGINT AS l_partkey, 1 AS l_linenumber, 2.0 AS l_quantity, 0.1 AS l_discount, 'F' AS l_linestatus, 'A' AS l_returnflag, {} AS pad FROM range(150) t(k)"
    (tmp_path / "lineitem.parquet").mkdir()
    # The larger file is read first.
    for name, supplier, pad in (("a", 1, "''"), ("b", 2, "repeat(md5(k::VARCHAR), 99)"), ("c", 3, "'c'")):
        duckdb.sql(f"COPY ({select.format(supplier, pad)}) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    got = QUERIES["feature_rows_first"](spark, str(tmp_path)).collect()
    # Three rows of each number, so the last row is one of three.
    assert len(got) == 100 and [r["seqid"] for r in got if r["id"] == "33_1"] == ["1"]
