"""Queries over the modular data set with known answers."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions.ip import normalize_ip
from tracewell.operators import catalog, indexes
from tracewell.plans.compiler import compile, format_result, query, search
from tracewell.plans.parser import parse
from tracewell.types import Column, QueryError, Schema, SchemaError

SCHEMA = Schema("test-flow", (Column("timestamp", "timestamp"), Column("srcip", "ip", True), Column("dstport", "port", True), Column("country", "enum", True, True), Column("asn", "uint", True), Column("eventtype", "enum"))).check()


@pytest.fixture(scope="module")
def flows(spark):
    i = F.col("seq")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (i % n + 1).cast("int"))
    rows = spark.range(1000).withColumnRenamed("id", "seq").withColumn("a", F.concat(F.lit("198.51.100."), (i % 256).cast("string")))
    out = rows.select("seq", (F.lit(1_700_000_000_000_000_000) + i * 1_000_000).alias("timestamp"), normalize_ip(F.col("a")).alias("srcip"), pick((22, 3389, 443), 3).cast("bigint").alias("dstport"), pick(("RU", "CN", "US"), 3).alias("country"), pick((15169, 13335), 2).cast("bigint").alias("asn"), F.lit("ssh.bruteforce").alias("eventtype"))
    return out.cache()


def count(df, where, schema=SCHEMA):
    return query(df, schema, f"SELECT count(*) FROM t WHERE {where}").first()[0]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("country = 'RU'", 334), ("dstport = 22 AND asn = 15169", 167), ("dstport IN (22, 3389)", 667), ("srcip = '198.51.100.5'", 4), ("srcip = 198.51.100.5", 4), ("country != 'RU'", 666),
        ("dstport < 443", 334), ("dstport > 443", 333), ("dstport = '22'", 334), ("dstport != 'x'", 0), ("dstport IN (22, 'x')", 334), ("dstport IN ('x')", 0), ("timestamp > '2023-11-14T22:13:20.5Z'", 499),
        ("timestamp < 1700000000001000000", 1), ("country = ''", 0), ("asn < 18446744073709551615", 1000), ("asn = 18446744073709551615", 0), ("srcip > 198.51.100.250", 15),
    ],
)
def test_counts(flows, where, want):
    assert count(flows, where) == want


def test_count_all_ignores_limit(flows):
    assert query(flows, SCHEMA, "SELECT count(*) FROM t LIMIT 3").first()[0] == 1000


def test_top_breaks_ties_by_text(flows):
    assert [tuple(r) for r in query(flows, SCHEMA, "SELECT top(dstport) FROM t").collect()] == [(22, 334), (3389, 333), (443, 333)]
    assert query(flows, SCHEMA, "SELECT top(srcip, 3) FROM t LIMIT 1").count() == 3


def test_nulls_match_nothing_and_stay_out_of_top(flows):
    holes = flows.withColumn("country", F.when(F.col("seq") % 7 != 0, F.col("country")))
    assert count(holes, "country != 'XX'") == 1000 - 143
    assert sum(r[1] for r in query(holes, SCHEMA, "SELECT top(country) FROM t").collect()) == 857


def test_rows(flows):
    some = query(flows, SCHEMA, "SELECT srcip, dstport FROM t WHERE country = 'CN' LIMIT 5")
    assert some.columns == ["srcip", "dstport"] and some.count() == 5
    assert query(flows, SCHEMA, "SELECT * FROM t LIMIT 0").count() == 1000
    assert query(flows, SCHEMA, "SELECT asn, asn FROM t LIMIT 2").columns == ["asn", "asn"]
    assert [r[0] for r in query(flows, SCHEMA, "SELECT timestamp FROM t LIMIT 3").collect()] == [1_700_000_000_000_000_000 + i * 1_000_000 for i in range(3)]


def test_search(flows):
    hits = search(flows, SCHEMA, "ip", "198.51.100.5")
    assert hits.columns == SCHEMA.names and hits.count() == 4
    assert search(flows, SCHEMA, "port", "22", 100).count() == 100
    assert search(flows, SCHEMA, "country", "US").count() == 333
    assert search(flows, SCHEMA, "ip", "no address").count() == 0
    for field in ("nothing", "Country"):
        with pytest.raises(QueryError):
            search(flows, SCHEMA, field, "x")
    with pytest.raises(QueryError):
        search(flows, Schema("s", (Column("asn", "uint"),)), "ip", "1.2.3.4")


@pytest.mark.parametrize("text", ["SELECT nope FROM t", "SELECT count(*) FROM t WHERE nope = 1", "SELECT top(nope) FROM t", "SELECT Country FROM t"])
def test_unknown_columns(flows, text):
    with pytest.raises(QueryError):
        query(flows, SCHEMA, text)


def test_format(flows):
    row = format_result(query(flows, SCHEMA, "SELECT * FROM t WHERE srcip = 198.51.100.5 LIMIT 1"), SCHEMA).first().asDict()
    assert row == {"timestamp": "2023-11-14T22:13:20.005Z", "srcip": "198.51.100.5", "dstport": "443", "country": "US", "asn": "13335", "eventtype": "ssh.bruteforce"}


def pruned(df, where, schema=SCHEMA):
    got = catalog.prune_counts(df, schema, parse(f"SELECT count(*) FROM t WHERE {where}"), 128).first()
    return got["pruned"], got["scanned"]


def test_pruning(flows):
    assert pruned(flows, "country = 'RU'") == (0, 8)
    assert pruned(flows, "srcip = '198.51.100.5'")[0] > 0
    assert pruned(flows, "srcip = '198.51.100.5' AND dstport < 1") == (0, 8)  # < always reads
    assert pruned(flows, "dstport = 'x'") == (8, 0)
    assert pruned(flows, "timestamp = 1700000000000000000") == (7, 1)  # bounds alone
    assert catalog.prune_counts(flows, SCHEMA, parse("SELECT count(*) FROM t"), 128).first()[:] == (0, 0)


def test_useful_pruning_keeps_all_matches(flows):
    wide = catalog.segment_catalog(flows, SCHEMA, 128)
    for where in ("timestamp > 1700000000900000000", "timestamp < 1700000000100000000 OR asn = 1", "dstport = 22 AND timestamp > 1700000000900000000", "country != 'RU'"):
        s = parse(f"SELECT * FROM t WHERE {where}")
        kept = {r[0] for r in wide.where(catalog.may_match(SCHEMA, s.where)).select("segment_id").collect()}
        need = {r[0] // 128 for r in flows.where(F.lit(True)).join(compile(flows.withColumnRenamed("seq", "n").withColumn("seq", F.col("n")), Schema("x", (*SCHEMA.columns, Column("n", "uint"))), s), F.col("n") == flows.seq).select(flows.seq).collect()}
        assert need <= kept


def test_postings(spark):
    schema_rows = [(i, p) for i, p in enumerate((22, 22, 80, 443, 22, 80))]
    df = spark.createDataFrame(schema_rows, "seq long, dstport long")
    index = indexes.postings(df, "dstport", 128)
    assert {r["value"]: r["count"] for r in indexes.posting_counts(index).collect()} == {22: 3, 80: 2, 443: 1}
    bits = {r["value"]: bytes(r["bits"]) for r in index.collect()}
    assert bits[22][0] == 0b10011
    assert indexes.matched_rows(indexes.either(index.where("value = 22"), index.where("value = 80"))).first()[0] == 5
    assert indexes.matched_rows(indexes.both(index.where("value = 22"), index.where("value = 80"))).first()[0] == 0


def test_postings_of_rare_values_are_small(spark):
    values = {i: i % 3 if i % 2 else 1000 + i for i in range(5000)}
    df = spark.createDataFrame(list(values.items()), "seq long, v long")
    for segment in (1024, 65_536):
        index = indexes.postings(df, "v", segment).cache()
        assert sum(len(r["bits"]) for r in index.collect()) <= 64 * len(values)
        held = {(r["segment_id"] * segment + (r["bucket"] - 1) * indexes.PAGE + k, r["value"]) for r in index.collect() for k in range(8 * len(r["bits"])) if r["bits"][k // 8] >> k % 8 & 1}
        assert held == set(values.items())
        assert {tuple(r) for r in indexes.posting_counts(index).where("value < 3").collect()} == {(s, v, n) for s in range(-(-5000 // segment)) for v in range(3) if (n := sum(values[i] == v for i in range(s * segment, min(5000, (s + 1) * segment))))}
        odd, some = index.where("value < 3"), index.where("value in (0, 1, 1004, 1062, 4998)")
        assert indexes.matched_rows(indexes.both(odd, some)).first()[0] == sum(v in (0, 1) for v in values.values())
        assert indexes.matched_rows(indexes.either(odd, some)).first()[0] == 2500 + 3
        assert indexes.matched_rows(indexes.both(indexes.either(odd, some), some)).first()[0] == sum(v in (0, 1, 1004, 1062, 4998) for v in values.values())


def test_info_and_schema_rules(flows):
    assert catalog.info(flows, SCHEMA, 128) == {"schema": "test-flow", "rows": 1000, "columns": 6, "segments": 8, "min_ts": 1_700_000_000_000_000_000, "max_ts": 1_700_000_000_999_000_000}
    for columns in ((), (Column("", "uint"),), (Column("a", "uint"), Column("a", "port")), (Column("a", "blob"),)):
        with pytest.raises(SchemaError):
            Schema("s", columns).check()
