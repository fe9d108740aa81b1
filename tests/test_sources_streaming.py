"""Connectors on small files, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graphs, states
from siltstone.sources import files as S
from siltstone.streaming import live

EVENTS = "user long, ts timestamp, event_id long, kind string"


def test_scan_decode_and_binary(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, data in {"a.c": b"int x;", "b.h": "﻿é".encode(), "c.c": "日本語".encode("cp932"), "d.c": "日本語テキスト".encode("euc_jp"), "e.c": b"\xff\xfeA\x00", "f.c": b"a\x00b", "g.png": b"x", "src/skip.c": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    files = S.scan_files(spark, str(tmp_path), "*.c,*.h,*.png", "src/\n")
    got = {r.path: (r.encoding, r.text) for r in S.decode_text(S.drop_binary(files)).collect()}
    assert got == {"a.c": ("UTF8", "int x;"), "b.h": ("UTF8_BOM", "é"), "c.c": ("SJIS", "日本語"), "d.c": ("EUCJP", "日本語テキスト"), "e.c": ("UTF16LE", "A")}


def test_tags_and_xref(spark, tmp_path):
    (tmp_path / "tags").write_text('!_TAG\tx\nfoo\ta.c\t/^int foo(\tint x)$/;"\tf\tline:12\nBAR\tb.h\t7;"\td\n')
    got = {tuple(r) for r in S.read_tags(spark, str(tmp_path / "tags")).collect()}
    assert got == {("foo", "a.c", 12, "func", "int foo(\tint x)"), ("BAR", "b.h", 7, "define", None)}
    (tmp_path / "xref").write_text("foo  12 a.c int foo(int x)\nshort 3 b.c\n")
    assert S.read_xref(spark, str(tmp_path / "xref"), "def").count() == 1 and S.read_xref(spark, str(tmp_path / "xref"), "ref").count() == 2


def test_project_and_refmap(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"nodes": [{"id": "1", "label": "x"}], "line_memos": {"a.c::3": "m"}, "line_pins": {"a.c::4": "t"}, "other": 1}))
    tables = S.read_project(spark, str(tmp_path / "p.json"))
    assert tables["nodes"].first()["memo"] is None and tables["line_notes"].count() == 2 and tables["edges"].count() == 0
    edges = spark.createDataFrame([("a", "b", 1)], "src string, def string, count long")
    assert S.load_refmap(spark, f"{tmp_path}/map", 1, 2, "r") is None
    S.save_refmap(edges, f"{tmp_path}/map", 1, 2, "r")
    assert S.load_refmap(spark, f"{tmp_path}/map", 1, 2, "r").count() == 1 and S.load_refmap(spark, f"{tmp_path}/map", 9, 2, "r") is None


@pytest.fixture
def stream(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 4).alias("user"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"), F.col("id").alias("event_id"), F.element_at(F.array(*map(F.lit, "abcaab")), (F.col("id") * F.col("id") % 6 + 1).cast("int")).alias("kind"))
    for i in range(3):
        rows.filter(f"event_id div 20 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    return rows, [f"{tmp_path}/in{i}" for i in range(3)]


def _run(df, tmp_path, sink=None, mode="append"):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{tmp_path}/out")).start()
    q.awaitTermination(120)


def _source(spark, tmp_path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in*"))


def test_steps_match_batch(spark, tmp_path, stream):
    rows, _ = stream
    _run(live.stream_steps(_source(spark, tmp_path), "user", ["ts", "event_id"], "kind"), tmp_path)
    got = {(r.user, r.src, r.dst, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = states.event_transitions(rows, "user", ["ts", "event_id"], "kind").select("user", "from", "to", "event_id")
    assert got == {tuple(r) for r in batch.collect()}
    trail = graphs.trail_edges(rows.select(F.col("user").alias("session"), F.col("event_id").alias("seq"), F.col("kind").alias("item")))
    assert {(u, a, b) for u, a, b, _ in got if a != b} == {tuple(r) for r in trail.collect()}


def test_capped_search(spark, tmp_path, stream):
    hits = _source(spark, tmp_path).filter("kind = 'a'")
    _run(hits, tmp_path, live.capped_sink(7, f"{tmp_path}/hits"))
    assert spark.read.parquet(f"{tmp_path}/hits").count() == 7


def test_replace_by_path(spark, tmp_path):
    write = live.replace_by_path(f"{tmp_path}/index", 4)
    write(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "path string, v int"), 0)
    write(spark.createDataFrame([("a", 9), ("c", 3)], "path string, v int"), 1)
    assert {(r.path, r.v) for r in spark.read.parquet(f"{tmp_path}/index").collect()} == {("a", 9), ("b", 1), ("c", 3)}


def test_transitions_wait_for_late_rows(spark, tmp_path):
    base = 1_700_000_000
    rows = [("u", base + s, c) for s, c in ((0, "a"), (20, "c"), (10, "b"), (30, "d"), (500, "y"), (900, "z"))]
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:])):  # b comes a batch late, but within the delay
        df = spark.createDataFrame(part, "user string, s long, kind string").select("user", F.timestamp_seconds("s").alias("ts"), "kind")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("user string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    _run(live.stream_transitions(source, "user", "ts", "kind", "2 minutes"), tmp_path)
    got = sorted((r.src, r.dst) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "y")]


def test_project_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "a.c", 3, "x", None, "t")], "id string, path string, line_no int, label string, memo string, tree_id string")
    notes = spark.createDataFrame([("a.c::3", "m", None, None, None), ("a.c::4", None, "c", "s", "p")], "key string, memo string, category string, source string, pinned string")
    S.write_project({"nodes": nodes, "line_notes": notes}, f"{tmp_path}/project")
    back = S.read_project(spark, f"{tmp_path}/project")
    assert [tuple(r) for r in back["nodes"].collect()] == [tuple(r) for r in nodes.collect()]
    assert {tuple(r) for r in back["line_notes"].select("key", "memo", "category", "source", "pinned").collect()} == {tuple(r) for r in notes.collect()}
    assert back["edges"].count() == back["range_notes"].count() == 0


def test_forced_encoding(spark):
    files = spark.createDataFrame([("a", bytearray("日本\n語 x".encode("euc_jp"))), ("b", bytearray("x".encode("cp932")))], "path string, content binary")
    assert [(r.path, r.line_no) for r in S.search_encoded(files, "euc-jp", "語").collect()] == [("a", 2)]
    assert S.search_encoded(files, "utf-16be", "語").count() == 0


def test_stream_search_and_stale_monitor(spark, tmp_path, stream):
    found = live.stream_search(spark, str(tmp_path / "in0"), EVENTS, "A", text="kind")
    _run(found, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{tmp_path}/in0").filter("kind = 'a'").count()
    files = spark.createDataFrame([("a", 5), ("b", 50), ("c", 7)], "path string, mtime long")
    index = spark.createDataFrame([("a", 10), ("b", 10)], "path string, indexed_at long")
    assert tuple(live.stale_monitor(files, index).first()) == (2, 50)
    events = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y")], "key string, at int, value string")
    assert tuple(live.latest_by_key(events, "key", "at", "value").first()) == ("k", "z", 3)
