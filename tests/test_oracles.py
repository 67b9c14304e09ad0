"""Every query with an SQL twin gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from tracewell import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet(['{small}/{t}.parquet'])" if not __import__("os").path.isdir(f"{small}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet/*.parquet'")
    return c


def cell(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows(spark, small, duck, name):
    df = core.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(core.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(cell(dict(zip(names, r))[c]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_ip_v6_roundtrip_of_users_beyond_a_group(spark, tmp_path):
    users = [None, 0, 1, 254, 65533, 65534, 65535, 65536, 89_999, 2**40]
    spark.createDataFrame([(k, u) for k, u in enumerate(users)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    want = duckdb.sql(core.SQL["ip_v6_roundtrip"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in core.QUERIES["ip_v6_roundtrip"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and want[8][1] == "2001:db8::15f90:0:9"


def test_stored_queries_over_many_segments(spark, tmp_path):
    """Several segments and files, and addresses that are nearly all different."""
    rows = spark.range(5000).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "id * 31 AS user_id", "'click' AS event_type", "id / 7.0D AS value")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stored_count", "stored_top", "stored_postings"):
        want = duckdb.sql(core.SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
        assert [tuple(r) for r in core.QUERIES[name](spark, str(tmp_path)).collect()] == want
