"""Readers, snapshots and streaming twins."""

import gzip

import pytest
from pyspark.sql import functions as F

from lexispark.sources import logs, snapshots
from lexispark.streaming import jobs


def test_lines_of_charsets_and_gzip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿一行\r\n二行\n".encode())
    (tmp_path / "b.txt").write_bytes("表示\nソ".encode("cp932"))
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(b"x\ny"))
    get = lambda n, c="UTF-8": [(r.line, r.text) for r in logs.read_lines(spark, str(tmp_path / n), c).orderBy("line").collect()]
    assert get("a.txt") == [(1, "一行"), (2, "二行"), (3, "")]
    assert get("b.txt", "cp932") == [(1, "表示"), (2, "ソ")]
    assert get("c.txt.gz") == [(1, "x"), (2, "y")]


def test_html(spark):
    page = "<html><style>x{}</style><body><p>a &lt;b&gt;<br>c</p><script>1</script><b>bo<i>ld</i></b> <span style='color:red'>r</span><div style='display:none'>no</div></body>"
    df = spark.createDataFrame([(1, page), (2, None)], "k bigint, h string")
    assert df.select(logs.html_text(F.col("h"))).first()[0].split("\n")[:2] == ["a <b>", "c"]
    lines = logs.visible_lines(page)
    assert [x[1] for x in lines] == ["a <b>", "c", "bold r"] and lines[2][2] == [(0, 2, "bold"), (2, 4, "bold"), (5, 6, "red")]
    assert logs.html_lines(df, "k", "h").count() == 3
    with pytest.raises(ValueError):
        logs.visible_lines("<a>" * 600)


def test_embedded_json_and_log(spark):
    df = spark.createDataFrame([('x push([1, {"a": 2}]) y', )], "s string")
    assert df.select(logs.embedded_json(F.col("s"), "push(", "array<string>")).first()[0][0] == "1"
    lines = spark.createDataFrame([("f", 1, "1: n"), ("f", 2, "body"), ("f", 3, ""), ("f", 4, ">>1"), ("f", 5, "2: m")], "file string, line int, text string")
    got = [(r.category, r.post) for r in logs.segment_log(lines, "file").orderBy("line").collect()]
    assert got == [("header", 1), ("body", 1), ("blank", 1), ("anchor", 1), ("header", 5)]


def test_snapshot_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    one = snapshots.publish({"t": a}, root)
    assert snapshots.publish({"t": a}, root) == one
    snapshots.activate(spark, root, one)
    two = snapshots.publish({"t": a.limit(1)}, root)
    assert two != one and snapshots.load(spark, root)["t"].count() == 2
    snapshots.activate(spark, root, two)
    assert snapshots.load(spark, root)["t"].count() == 1
    with pytest.raises(ValueError):
        snapshots.publish({"t": a.limit(0)}, root)
    a.union(a).write.mode("overwrite").parquet(f"{root}/dataset={one}/t")
    with pytest.raises(ValueError):
        snapshots.load(spark, root, one)


def test_stage_machine():
    assert jobs.advance(-1, False, ["queued", "planning", "analyzing", "completed", "failed"])[2] == ["queued", "planning", "completed"]


def test_job_stream(spark, tmp_path):
    src = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "completed"), ("a", 3, "failed"), ("b", 1, "planning"), ("b", 2, "queued")], "job string, ts int, event string")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    jobs.append_to(jobs.job_stages(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.job, r.stage, r.ended) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "completed", True), ("b", "planning", False)}


def test_latest_stream(spark, tmp_path):
    src = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, r int, v string")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    jobs.append_to(jobs.latest_stream(stream, "k", "r", "v"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "y"), ("b", "z")}
