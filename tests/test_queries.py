"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
NAMES = sorted(n for n in QUERIES if n in SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, int):
        return f"{v:.8g}" if abs(v) < 10**7 else str(v)
    if isinstance(v, dict):
        v = list(v.values())
    return str([plain(x) for x in v])


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    got = {r.split: r.n for r in __spark_entry__.entry(spark).collect()}
    assert set(got) <= {"train", "val", "test"} and sum(got.values()) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_groups_without_rows_have_no_row(spark, tmp_path):
    """cch_materialized where the published part of the table is empty: SQL groups rows that are not there."""
    part = spark.createDataFrame([(f"p{i % 3}", 50 - i // 3) for i in range(9)] + [(None, 4)], "p_name string, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(duck.sql(SQL["cch_materialized"]).fetchall())
    got = QUERIES["cch_materialized"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("policy", "found", "n", "v").collect())) == want and len(want) == 3
