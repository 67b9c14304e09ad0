import io

import pytest

from tracewell import cli
from tracewell.operators import store
from tracewell.plans.compiler import query


def test_pack_info_query_search(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    lines, table = str(tmp_path / "lines"), str(tmp_path / "table")
    assert cli.main(["gen", "honeypot", "-n", "400", "-o", lines]) == 0
    assert cli.main(["pack", lines, "-s", "honeypot", "-o", table]) == 0
    assert "400 records, 0 skipped" in capsys.readouterr().out
    assert cli.main(["info", table]) == 0
    out = capsys.readouterr().out
    assert "400 rows, 10 columns" in out and "2024-06-01T00:00:00." in out and "srcip\tip indexed" in out
    assert cli.main(["query", "SELECT top(dstport, 2) FROM t", table]) == 0
    top = capsys.readouterr().out.splitlines()
    assert top[0] == "dstport\tcount" and len(top) == 3
    assert cli.main(["search", "port", "22", table, "--limit", "5"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 6
    assert cli.main(["query", "SELECT nothing FROM t", table]) == 1
    assert "unknown column" in capsys.readouterr().err


def test_ingest_once(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["gen", "web-access", "-n", "50", "-o", str(tmp_path / "in")]) == 0
    assert cli.main(["ingest", str(tmp_path / "in"), "-s", "web-access", "-o", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "cp"), "--once"]) == 0
    assert "50 lines, 50 records, 0 skipped" in capsys.readouterr().out


def test_show_writes_nulls_as_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "asn long, country string")
    schema = store.Schema.from_struct(df.schema)
    out = io.StringIO()
    cli.show(query(df, schema, "SELECT asn, country FROM t"), schema, out)
    assert out.getvalue() == "asn\tcountry\n1\t\n"


def test_version(capsys):
    assert cli.main(["version"]) == 0 and "tracewell" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nope"])


@pytest.mark.parametrize("once", [True, False])
def test_standard_input(spark, tmp_path, capsys, monkeypatch, once):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    monkeypatch.setattr(cli.sys, "stdin", type("Stdin", (), {"buffer": io.BytesIO(b'{"ts":1}\nbad\n{"ts":2}')}))
    assert cli.main(["ingest", "-", "-s", "generic-flow", "-o", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "cp"), "--interval", "0.2", *(["--once"] if once else [])]) == 0
    assert "3 lines, 2 records, 1 skipped" in capsys.readouterr().out
    assert sorted(r["timestamp"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [10**9, 2 * 10**9]


def test_pieces_hold_whole_lines(spark, tmp_path, monkeypatch):
    from tracewell.sources import spool

    monkeypatch.setattr(spool, "PIECE", 64)
    text = b"".join(b"line %d of some length\n" % k for k in range(5000)) + b"last"
    made = spool.Spool(spark, io.BytesIO(text), str(tmp_path / "s"))
    made.run()
    files = sorted(p for p in (tmp_path / "s").iterdir() if p.name.endswith(".txt"))
    assert made.error is None and len(files) > 1 and b"".join(p.read_bytes() for p in files) == text
    assert all(p.read_bytes().endswith(b"\n") for p in files[:-1])


def test_pack_options(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    (tmp_path / "x").write_text('{"ts":1,"bytes":18446744073709551615,"country":"us"}\n')
    assert cli.main(["pack", str(tmp_path / "x"), "-s", "generic-flow", "-o", str(tmp_path / "t"), "--wide", "--index", "--segment-rows", "10", "--compression", "lz4"]) == 0
    assert cli.main(["query", "SELECT bytes FROM t WHERE bytes = 18446744073709551615", str(tmp_path / "t")]) == 0
    assert "18446744073709551615" in capsys.readouterr().out
    assert cli.main(["query", "SELECT top(country) FROM t", str(tmp_path / "t")]) == 0 and "US\t1" in capsys.readouterr().out
    assert cli.main(["info", str(tmp_path / "nothing")]) == 1 and "no table" in capsys.readouterr().err


def test_sigterm_commits_what_has_come(spark, tmp_path, capsys, monkeypatch):
    import os
    import signal
    import threading
    import time

    monkeypatch.setattr(cli, "_session", lambda: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"ts":1}\n{"ts":2}\n')

    def end():
        until = time.time() + 60
        while time.time() < until and not list(tmp_path.glob("out/_spark_metadata/0")):
            time.sleep(0.2)
        (tmp_path / "in" / "b.txt").write_text('{"ts":3}\n')
        os.kill(os.getpid(), signal.SIGTERM)

    threading.Thread(target=end, daemon=True).start()
    assert cli.main(["ingest", str(tmp_path / "in"), "-s", "generic-flow", "-o", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "cp"), "--interval", "0.2"]) == 0
    assert "3 lines, 3 records, 0 skipped" in capsys.readouterr().out


def test_recover_passes_over_cut_files(spark, tmp_path, capsys, monkeypatch):
    from pyspark.sql import functions as F

    from tracewell.sources import adapters, datagen

    monkeypatch.setattr(cli, "_session", lambda: spark)
    rows = adapters.records(datagen.generate(spark, "honeypot", 400), "honeypot").withColumn("seq", F.monotonically_increasing_id())
    store.write_table(rows.repartition(4), str(tmp_path / "t"), store.read_table.__globals__["Schema"].from_struct(rows.drop("seq").schema))
    parts = sorted((tmp_path / "t").glob("part-*"))
    parts[-1].write_bytes(parts[-1].read_bytes()[:-200])
    for crc in (tmp_path / "t").glob(".part-*.crc"):
        crc.unlink()
    assert cli.main(["query", "SELECT count(*) FROM t", str(tmp_path / "t"), "--recover"]) == 0
    assert capsys.readouterr().out.splitlines()[1] == "300"
