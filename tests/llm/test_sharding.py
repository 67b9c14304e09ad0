import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import sharding
from tracewell.llm.queries import op1_sharding


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 100, 1000, 1023])
def test_permutation_is_one_to_one(spark, total):
    got = [r[0] for r in sharding.permute(spark.range(total).withColumnRenamed("id", "n"), "n", total, 5, "p").select("p").collect()]
    assert sorted(got) == list(range(total))


def test_walk_goes_on_past_the_laid_out_steps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WALK", 1)
    got = [r[0] for r in sharding.permute(spark.range(10).withColumnRenamed("id", "n"), "n", 10, 5, "p").select("p").collect()]
    monkeypatch.setattr(sharding, "WALK", 6)
    assert sorted(got) == list(range(10)) and got == [r[0] for r in sharding.permute(spark.range(10).withColumnRenamed("id", "n"), "n", 10, 5, "p").select("p").collect()]


def test_query_against_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op1_sharding(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    by = {}
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_place_depends_on_rows_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = {tuple(r) for r in sharding.shard_plan(docs).collect()}
    assert one == {tuple(r) for r in sharding.shard_plan(docs.repartition(7, "source").orderBy(F.rand(3))).collect()}
    assert one != {tuple(r) for r in sharding.shard_plan(docs, seed=1).collect()}
    order = [r["doc_id"] for r in sorted(sharding.shard_plan(docs).collect(), key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order)


def test_hot_equal_rows_are_unfolded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 16)
    docs = spark.range(100).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    rows = sharding.shard_plan(docs, 4).collect()
    assert len(rows) == 150 and sorted((r["shard"], r["slot"]) for r in rows) == sorted((p % 4, p // 4) for p in range(150))


def test_written_shards(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_main_path_is_native(spark, small):
    plan = sharding.shard_plan(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "a", 1), (None, "a", 2), (5, "x", 3), (5, "y", 4), (5, "x", 5), (6, None, 6), (6, "", 7)] + [(9, "same", 100 + k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash")).repartition(5)
    sharding.write_shards(docs, str(tmp_path / "s"), 4, files=6)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r["mark"], r["text"], r["doc_id"]) for r in back if r["doc_id"]) == sorted((m, t, d) for d, t, m in rows if d) and sorted(r["mark"] for r in back) == sorted(m for *_, m in rows)
    assert sorted((r["shard"], r["slot"]) for r in back) == sorted((p % 4, p // 4) for p in range(len(rows))) and {r["size"] for r in back} == {"clash"}
    plan = sharding.shard_plan(docs, 4).collect()
    key = lambda d, t: (d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((*key(r["doc_id"], r["text"]), r["shard"], r["slot"]) for r in back) == sorted((r["doc_id"] or -1, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in plan)
    for file in (tmp_path / "s").rglob("part-*"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 4)
    assert not list((tmp_path / "none").glob("shard=*"))
