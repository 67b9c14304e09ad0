"""Sources, storage, codecs and streaming."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.functions.ip import format_ip
from tracewell.operators import codecs, store
from tracewell.plans.compiler import query
from tracewell.sources import adapters, datagen
from tracewell.sources.follow import _added, follow
from tracewell.sources.lines import read_lines
from tracewell.streaming.ingest import Stats, ingest, pack, pack_numbered, stats
from tracewell.types import HONEYPOT, SCHEMAS, Column, Schema, TracewellError


def decoded(spark, source, *lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    return [r["record"] for r in sorted(adapters.decode_lines(df, source).collect(), key=lambda r: r["i"])]


def test_registry():
    assert adapters.names() == ["generic-flow", "honeypot", "web-access"]
    with pytest.raises(TracewellError):
        adapters.get("nope")


def test_flow_lines(spark):
    good = '{"timestamp":"2024-06-01T00:00:00Z","srcip":"203.0.113.5","dstip":"2001:db8::1","srcport":5,"dstport":"443","protocol":"TCP","asn":1,"country":"us","eventtype":"Flow","bytes":10.9,"packets":-3}'
    rows = decoded(spark, "generic-flow", good, "", "  \t", "{", "[1]", "null", '{"a":1}', '{"ts":{"x":1}}', '{"ts":1717200000}', '{"timestamp":null,"ts":"1717200000"}', '{"ts":5,"src_ip":"bad","saddr":"1.2.3.4","dst_port":"x","dport":7}', '{"ts":5,"country":true,"protocol":6}', '{"ts":5,"asn":-1,"src_asn":9}', "{'ts':5}")
    assert rows[0].asDict() | {"srcip": None, "dstip": None} == {"timestamp": 1_717_200_000 * 10**9, "srcip": None, "dstip": None, "srcport": 5, "dstport": 443, "protocol": "TCP", "asn": 1, "country": "US", "eventtype": "Flow", "bytes": 10, "packets": None}
    assert rows[0]["srcip"].hex().endswith("ffffcb007105") and len(rows[0]["dstip"]) == 16
    assert rows[1:8] == [None] * 7
    assert rows[8]["timestamp"] == rows[9]["timestamp"] == 1_717_200_000 * 10**9
    assert rows[10]["srcip"] is None and rows[10]["dstport"] == 7
    assert (rows[11]["country"], rows[11]["protocol"]) == ("TRUE", "6")
    assert rows[12]["asn"] is None and rows[13] is None


def test_honeypot_lines(spark):
    row = decoded(spark, "honeypot", '{"eventtime":"2024-06-01 00:00:00","peerIP":"203.0.113.5","hostPort":22,"service":"ssh","event":"scan","pass":""}')[0]
    assert (row["username"], row["password"], row["protocol"], row["dstport"]) == (None, "", "ssh", 22)


def test_web_lines(spark):
    line = '203.0.113.5 - - [01/Jun/2024:00:00:00 +0000] "GET /admin/login HTTP/1.1" 401 12 "-" "Mozilla/5.0"'
    rows = decoded(spark, "web-access", line, "#" + line, "a b c", line.replace("01/Jun", "99/Jun"), line.replace("GET /admin/login HTTP/1.1", "GET"), line.replace("401 12", "- -"), line.replace("203.0.113.5", "host"), line.replace(' "-" "Mozilla/5.0"', ""))
    assert rows[0].asDict() | {"srcip": None} == {"timestamp": 1_717_200_000 * 10**9, "srcip": None, "method": "GET", "path": "/admin/login", "status": 401, "bytes": 12, "referer": None, "useragent": "Mozilla/5.0"}
    assert rows[1:5] == [None] * 4
    assert (rows[5]["status"], rows[5]["bytes"]) == (None, 0) and rows[6]["srcip"] is None and rows[7]["useragent"] is None


@pytest.mark.parametrize("source", datagen.SOURCES)
def test_generated_lines_decode(spark, source):
    lines = datagen.generate(spark, source, 300, seed=3)
    assert [r[0] for r in lines.collect()] == [r[0] for r in datagen.generate(spark, source, 300, seed=3).collect()]
    rows = adapters.records(lines, source)
    assert rows.count() == 300 and rows.columns == SCHEMAS[source].names
    assert rows.where("srcip is null or timestamp is null").count() == 0


def test_pack_and_read(spark, tmp_path):
    text, out = str(tmp_path / "in"), str(tmp_path / "out")
    datagen.generate(spark, "honeypot", 500).unionByName(spark.createDataFrame([("junk",), ("",)], "value string")).write.text(text)
    assert pack(spark, "honeypot", [text], out) == Stats(502, 500, 2)
    df, schema = store.read_table(spark, out)
    assert [c.logical for c in schema.columns] == [c.logical for c in HONEYPOT.columns] and schema.find("srcip").indexed
    assert query(df, schema, "SELECT count(*) FROM t").first()[0] == 500
    plan = query(df, schema, "SELECT count(*) FROM t WHERE dstport = 22 AND country IN ('CN', 'US')")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(dstport,22)" in plan and "In(country" in plan and "ReadSchema: struct<dstport:bigint,country:string>" in plan
    assert store.parse_schema(store.describe(HONEYPOT)) == HONEYPOT


def test_numbered_rows_are_gapless(spark, tmp_path):
    lines = datagen.generate(spark, "generic-flow", 350).repartition(5)
    pack_numbered(lines.unionByName(lines.limit(0)), "generic-flow", str(tmp_path / "t"))
    df, _ = store.read_table(spark, str(tmp_path / "t"))
    assert sorted(r[0] for r in df.select("seq").collect()) == list(range(350))
    assert store.number_rows(spark.range(0)).count() == 0


def test_stream_resumes(spark, tmp_path):
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in range(2):
        datagen.generate(spark, "generic-flow", 100, seed=part).coalesce(1).write.mode("append").text(source)
        q = ingest(spark.readStream.text(source), "generic-flow", out, at, every=None)
        q.awaitTermination()
        assert stats(q) == Stats(100, 100, 0)  # only what is new
        assert spark.read.parquet(out).count() == 100 * (part + 1)


def test_follow_growing_file(spark, tmp_path):
    log = tmp_path / "app.log"
    log.write_text("old\n")
    assert _added(str(log), 0, None) == ([("old",)], 4)
    q = follow(spark, str(log)).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        with log.open("a") as f:
            f.write("one\ntwo\nhalf")
        deadline = time.time() + 40
        while time.time() < deadline and spark.table("followed").count() < 3:
            time.sleep(0.3)
        assert [r[0] for r in spark.table("followed").collect()] == ["old", "one", "two"]
    finally:
        q.stop()


def test_long_lines_are_left_out(spark, tmp_path):
    (tmp_path / "x").write_text("a\n" + "b" * (4 << 20) + "c\nd\n")
    assert [r[0] for r in read_lines(spark, str(tmp_path / "x")).collect()] == ["a", "d"]


# ---- codec sizes against encoders written out byte by byte --------------------------------------


def uv(n):
    return max(1, -(-n.bit_length() // 7))


def sizes(v):
    zz = lambda d: 2 * d if d >= 0 else -2 * d - 1
    runs = [[v[0], 0]]
    for x in v:
        if x != runs[-1][0]:
            runs.append([x, 0])
        runs[-1][1] += 1
    d = [b - a for a, b in zip(v, v[1:])]
    words = sorted(set(v))
    return {
        "plain": 8 * len(v), "varint": sum(map(uv, v)), "rle": sum(uv(a) + uv(n) for a, n in runs), "bitpack": uv(min(v)) + 1 + -(-len(v) * (max(v) - min(v)).bit_length() // 8), "delta": uv(v[0]) + sum(uv(zz(x)) for x in d),
        "delta2": uv(v[0]) + (uv(zz(d[0])) if d else 0) + sum(uv(zz(b - a)) for a, b in zip(d, d[1:])), "dictionary": uv(len(words)) + sum(uv(b - a) for a, b in zip([0, *words], words)) + 1 + -(-len(v) * (len(words) - 1).bit_length() // 8),
    }


def test_int_codecs(spark):
    rng = random.Random(1)
    columns = {"constant": [7] * 300, "sequence": list(range(1000, 1300)), "clock": [10**18 + i * 10**6 + rng.randrange(1000) for i in range(300)], "two": [rng.choice((5, 9)) for _ in range(300)], "random": [rng.randrange(2**40) for _ in range(300)]}
    rows = [(i, *(c[i] for c in columns.values())) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, " + ", ".join(f"{c} long" for c in columns))
    for r in codecs.int_profile(df, list(columns), 100).collect():
        v = columns[r["column"]][r["segment_id"] * 100 : r["segment_id"] * 100 + 100]
        assert {k: r[k] for k in sizes(v)} == sizes(v)
        assert r[r["codec"]] <= r["plain"]
    chosen = {r["column"]: r["codec"] for r in codecs.int_profile(df, list(columns), 300).collect()}
    assert chosen["constant"] == "bitpack" and chosen["sequence"] == "delta" and chosen["two"] in ("dictionary", "bitpack")


def test_bytes_codecs(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "ab" if i % 2 else "xyz", str(i), "k") for i in range(40)], "seq long, a string, b string, c string")
    got = {r["column"]: r for r in codecs.bytes_profile(df, ["a", "b", "c"], 100).collect()}
    assert (got["a"]["raw"], got["a"]["dictionary"], got["a"]["codec"]) == (20 * 4 + 19 * 3 + 1, 1 + 4 + 3 + 1 + 1 + 10, "dictionary")
    assert got["b"]["codec"] == "raw" and got["c"]["codec"] == "rle" and got["c"]["rle"] == 3


def test_addresses_survive_storage(spark, tmp_path):
    adapters.records(datagen.generate(spark, "web-access", 50), "web-access").write.parquet(str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).where(format_ip(F.col("srcip")).rlike("^[0-9.]+$")).count() == 50


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "r"))
    stats_ = store.footer_stats(spark, str(tmp_path / "r"), "id")
    assert tuple(stats_.first()) == (1000, 0, 999)
    assert "PushedAggregation: [COUNT(*)" in stats_._jdf.queryExecution().executedPlan().toString()


def test_indexed_columns_have_bloom_filters(spark, tmp_path):
    """Where a dictionary outgrows its page; small dictionaries prune by themselves and need no filter."""
    rows = spark.range(150_000).select((F.col("id") * 10**6).alias("timestamp"), F.lit(bytearray(16)).alias("srcip"), F.col("id").alias("srcport"), F.lit(22).cast("bigint").alias("dstport"), F.lit("ssh").alias("protocol"), F.lit("scan").alias("eventtype"), F.md5(F.col("id").cast("string")).alias("username"), F.md5((F.col("id") + 1).cast("string")).alias("password"), F.lit("CN").alias("country"), F.col("id").alias("asn"))
    store.write_table(rows.coalesce(1), str(tmp_path / "t"), HONEYPOT, store.WriteOptions(distinct={"username": 150_000}))
    part = next(str(p) for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(part), conf))
    try:
        chunks = {c.getPath().toDotString(): c for c in reader.getFooter().getBlocks().get(0).getColumns()}
        assert chunks["username"].getBloomFilterOffset() > 0 and chunks["password"].getBloomFilterOffset() < 0  # password is not indexed
        assert chunks["timestamp"].getCodec().toString() == "ZSTD" and "DELTA_BINARY_PACKED" in chunks["timestamp"].getEncodings().toString()
    finally:
        reader.close()


def test_filters_of_small_segments_are_small(spark, tmp_path):
    rows = spark.range(64 * 1024).select((F.col("id") * 10**6).alias("timestamp"), F.md5(F.col("id").cast("string")).alias("username")).coalesce(1)
    schema, sizes = Schema("t", tuple(c for c in HONEYPOT.columns if c.name in rows.columns)), {}
    for bloom in (True, False):
        store.write_table(rows, str(tmp_path / str(bloom)), schema, store.WriteOptions(segment_rows=1024, bloom=bloom))
        sizes[bloom] = sum(p.stat().st_size for p in (tmp_path / str(bloom)).glob("part-*"))
    assert 64 * 1024 < sizes[True] - sizes[False] < 64 * 4096


def test_malformed_lines_are_skipped(spark):
    good = '{"ts":5,"asn":1}'
    bad = [good + " x", good + good, good + "]", "[" + good, good + "}", '{"ts":5,"bytes":NaN}', '{"ts":5,"bytes":Infinity}', '{"ts":5,"bytes":1e999}', '{"ts":5,"a":' + "[" * 100_000, '{"ts":"5\\n"}', '{"ts":"2024-06-01T00:00:00Z\\n"}', good + ',0],{"a":1}', '{"ts":5,"asn":01}', '{"ts":5,"a":"\t"}', "{'ts':5}", '{"ts":5,}']
    assert decoded(spark, "generic-flow", *bad) == [None] * len(bad)
    rows = decoded(spark, "generic-flow", " " + good + " ", '{"ts":5,"ts":6}', '{"ts":5,"dport":"22\\n","event":"a\\n"}', '{"ts":5,"event":"\\ud800x"}', '{"ts":5,"protocol":1e21,"event":1.50,"country":-0.000001}')
    assert rows[0]["asn"] == 1 and rows[1]["timestamp"] == 6 * 10**9
    assert rows[2]["dstport"] is None and rows[2]["eventtype"] == "a\n" and rows[3]["eventtype"].endswith("x")
    assert (rows[4]["protocol"], rows[4]["eventtype"], rows[4]["country"]) == ("1000000000000000000000", "1.5", "-0.000001")


def test_unsigned_numbers(spark):
    line = '{"ts":5,"bytes":18446744073709551615,"packets":"9223372036854775808","asn":18446744073709551616,"dstport":7}'
    lines = spark.createDataFrame([(line,)], "value string")
    wide, plain = adapters.records(lines, "generic-flow", wide=True).first(), adapters.records(lines, "generic-flow").first()
    assert (int(wide["bytes"]), int(wide["packets"]), wide["asn"], wide["dstport"]) == (2**64 - 1, 2**63, None, 7)
    assert (plain["bytes"], plain["packets"], plain["dstport"]) == (None, None, 7)


def test_lines_that_are_no_text(spark, tmp_path):
    (tmp_path / "x").write_bytes(b'{"ts":5,"event":"\xff\xfe"}\n{"ts":6}\n')
    rows = adapters.records(read_lines(spark, str(tmp_path / "x")), "generic-flow").collect()
    assert sorted(r["timestamp"] for r in rows) == [5 * 10**9, 6 * 10**9]


def test_every_line_is_counted(spark, tmp_path):
    (tmp_path / "x").write_text('{"ts":1}\n' + "b" * (4 << 20) + 'c\n{"ts":2}\n\n')
    assert pack(spark, "generic-flow", [str(tmp_path / "x")], str(tmp_path / "t")) == Stats(4, 2, 2)
    assert [r["seq"] for r in spark.read.parquet(str(tmp_path / "t")).orderBy("timestamp").collect()] == [0, 2]


def test_follower_passes_over_a_long_line(tmp_path, monkeypatch):
    from tracewell.sources import follow as module

    monkeypatch.setattr(module, "BATCH_BYTES", 1000)
    monkeypatch.setattr(module, "MAX_LINE", 300)
    log = tmp_path / "l"
    log.write_bytes(b"one\n" + b"x" * 5000 + b"\ntwo\n" + b"y" * 400 + b"\nthree\nhalf")
    at, got, steps = 0, [], []
    for _ in range(30):
        lines, end = module._added(str(log), at, None)
        assert module._added(str(log), at, end) == (lines, end)  # a replay gives the same
        got += [x for (x,) in lines]
        steps.append((at, end))
        at = end
    assert got == ["one", None, "two", None, "three"] and at == log.stat().st_size - 4
    with log.open("ab") as f:
        f.write(b"z" * 2000)
    lines, at = module._added(str(log), at, None)
    assert lines == [(None,)] and at < 0
    log.write_bytes(b"new\n")
    assert module._added(str(log), at, None) == ([("new",)], 4)


def test_segments_of_packed_tables(spark, tmp_path):
    import pyarrow.parquet as pq

    from tracewell.operators import catalog

    text, out = str(tmp_path / "in"), str(tmp_path / "out")
    datagen.generate(spark, "generic-flow", 5000).repartition(3).write.text(text)
    pack(spark, "generic-flow", [text], out, store.WriteOptions(segment_rows=1000, index=True))
    df, schema = store.read_table(spark, out)
    assert sorted(r[0] for r in df.select("seq").collect()) == list(range(5000))
    assert catalog.info(df, schema, 1000)["segments"] == 5 == catalog.zone_map(df, schema, 1000, ["asn"]).count()
    groups = [pq.ParquetFile(p).metadata.row_group(g).num_rows for p in (tmp_path / "out").glob("part-*") for g in range(pq.ParquetFile(p).num_row_groups)]
    assert max(groups) <= 1000 and sum(groups) == 5000
    plan = store.query_table(spark, out, "SELECT count(*) FROM t")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan
    top = store.query_table(spark, out, "SELECT top(country) FROM t")
    assert "_index/histogram/country" in top._jdf.queryExecution().executedPlan().toString() or "country" in top.columns
    assert [tuple(r) for r in top.collect()] == [tuple(r) for r in query(df, schema, "SELECT top(country) FROM t").collect()]
    assert store.query_table(spark, out, "SELECT count(*) FROM t WHERE country = 'CN'").first()[0] == df.where("country = 'CN'").count()
    assert store.read_index(spark, out, "postings", "bytes") is None
    with pytest.raises(TracewellError):
        store.read_table(spark, str(tmp_path / "nothing"))


def test_absent_keys_read_no_row_group(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") * 10**6).alias("timestamp"), F.lit(bytearray(16)).alias("srcip"), F.lit("GET").alias("method"), F.md5(F.col("id").cast("string")).alias("path"), F.lit(200).cast("bigint").alias("status"), F.lit(1).cast("bigint").alias("bytes"), F.lit("-").alias("referer"), F.lit("u").alias("useragent"))
    store.write_table(rows.coalesce(1), str(tmp_path / "t"), SCHEMAS["web-access"], store.WriteOptions(distinct={"path": 200_000}))
    df, schema = store.read_table(spark, str(tmp_path / "t"))
    found = query(df, schema, "SELECT path FROM t WHERE path = '0123456789abcdef0123456789abcdef'")
    assert found.collect() == []
    metrics = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(path" in metrics


def test_stream_numbers_and_totals(spark, tmp_path):
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    for k in range(105):
        (source / f"{k:03d}.txt").write_text(f'{{"ts":{k + 1}}}\nbad\n')
    q = ingest(spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)), "generic-flow", out, at, every=None)
    q.awaitTermination()
    assert len(q.recentProgress) <= 101 and stats(q) == Stats(210, 105, 105)
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert len({r["seq"] for r in rows}) == 105 and len({r["seq"] >> 37 for r in rows}) == 105


def test_numbers_in_statements():
    from tracewell.plans.binder import bind

    assert [bind("double", x) for x in ("1.5", "-2e3", "nan", "inf", "1_0", "", ".")] == [1.5, -2000.0, None, None, None, None, None]
    assert bind("timestamp", "2024-06-01\n") is None and bind("uint", "5\n") is None


@pytest.mark.parametrize("compression", ["zstd", "lz4", "uncompressed"])
def test_every_compression_reads_back(spark, tmp_path, compression):
    rows = adapters.records(datagen.generate(spark, "generic-flow", 200), "generic-flow")
    store.write_table(rows, str(tmp_path / "t"), SCHEMAS["generic-flow"], store.WriteOptions(compression))
    df, _ = store.read_table(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))


def test_a_damaged_page_is_noticed(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("timestamp"), *(F.xxhash64("id", F.lit(k)).alias(f"c{k}") for k in range(2)))
    schema = Schema("t", (Column("timestamp", "timestamp"), Column("c0", "uint"), Column("c1", "uint")))
    store.write_table(rows.coalesce(1), str(tmp_path / "t"), schema, store.WriteOptions("uncompressed"))
    part = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 0xFF
    part.write_bytes(bytes(data))
    for crc in (tmp_path / "t").glob(".part-*.crc"):
        crc.unlink()
    df, _ = store.read_table(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)checksum|corrupt|crc"):
        df.agg(F.sum(F.col("c0").cast("double")), F.sum(F.col("c1").cast("double"))).collect()


def test_a_table_knows_its_schema(spark, tmp_path):
    datagen.generate(spark, "web-access", 20).write.text(str(tmp_path / "in"))
    pack(spark, "web-access", [str(tmp_path / "in")], str(tmp_path / "out"))
    assert store.read_table(spark, str(tmp_path / "out"))[1] == SCHEMAS["web-access"]
