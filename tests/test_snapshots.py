"""Commits seen whole, lookups that read one bucket, and state that turns stale and leaves the store by the clock."""

import glob
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.streaming import live, snapshots


def _rows(spark, rows):
    return spark.createDataFrame(rows, "path string, v int")


def test_commits_replace_drop_and_repeat(spark, tmp_path):
    out = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, out)
    assert snapshots.commit(_rows(spark, [("a", 1), ("a", 2), ("b", 1), ("c", 1)]), out, batch=0, buckets=4) == 1
    seen = snapshots.current(spark, out)
    assert snapshots.commit(_rows(spark, [("a", 9), ("d", 3)]), out, _rows(spark, [("b", 0), ("zz", 0)]), batch=1) == 2
    assert snapshots.commit(_rows(spark, [("a", 7)]), out, batch=1) == 2  # a batch done twice
    plain = lambda df: sorted((r.path, r.v) for r in df.collect())
    assert plain(seen) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]  # opened before the commit
    assert plain(snapshots.current(spark, out)) == [("a", 9), ("c", 1), ("d", 3)]
    assert plain(snapshots.lookup(spark, out, "a")) == [("a", 9)] and snapshots.lookup(spark, out, "b").count() == 0
    assert snapshots.commit(_rows(spark, []), out, _rows(spark, [(p, 0) for p in "acd"]), batch=2) == 3
    assert snapshots.current(spark, out).count() == 0 and snapshots.current(spark, out, 2).count() == 3
    assert snapshots.vacuum(spark, out, keep=1) > 0 and snapshots.current(spark, out).count() == 0


def test_a_commit_without_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "index")
    snapshots.commit(_rows(spark, [("a", 1)]), out, buckets=2)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError()))
        snapshots.commit(_rows(spark, [("a", 2), ("b", 2)]), out)
    assert [(r.path, r.v) for r in snapshots.current(spark, out).collect()] == [("a", 1)]
    with pytest.raises(RuntimeError):
        snapshots._publish(spark, out, {"version": 1})


def test_a_lookup_reads_one_sorted_row_group(spark, tmp_path):
    out = str(tmp_path / "index")
    rows = spark.range(60_000).select(F.concat(F.lit("p"), (F.col("id") % 20_000).cast("string")).alias("path"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    snapshots.commit(rows, out, buckets=1)
    (file,) = glob.glob(f"{out}/data/*/bucket=0/*.parquet")
    groups = pq.ParquetFile(file).metadata
    stats = [groups.row_group(i).column(0).statistics for i in range(groups.num_row_groups)]
    assert len(stats) > 3 and sum(s.min <= "p777" <= s.max for s in stats) <= 2
    found = snapshots.lookup(spark, out, "p777")
    assert found.count() == 3 and "PushedFilters: [IsNotNull(path), EqualTo(path,p777)]" in found._jdf.queryExecution().executedPlan().toString()


def test_snapshot_sink_takes_deletions(spark, tmp_path):
    out, write = str(tmp_path / "index"), snapshots.snapshot_sink(str(tmp_path / "index"), buckets=2)
    batch = lambda rows: spark.createDataFrame(rows, "path string, v int, deleted boolean")
    write(batch([("a", 1, None), ("b", 1, False)]), 0)
    write(batch([("a", None, True), ("c", 2, False)]), 1)
    assert sorted((r.path, r.v) for r in snapshots.current(spark, out).collect()) == [("b", 1), ("c", 2)]


def test_a_value_turns_stale_and_its_state_expires(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = lambda rows, name: spark.createDataFrame(rows, "k string, s long, v string").select("k", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    events([("a", 10, "old"), ("a", 20, "new"), ("b", 5, "x")], "0")
    source = spark.readStream.schema("k string, ts timestamp, v string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    query = live.latest_state(source, "k", "ts", "v", fresh_ms=3000, keep_ms=9000).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").foreachBatch(lambda df, n: seen.extend((r.k, r.value, r.fresh) for r in df.collect())).start()
    try:
        until = time.time() + 90
        while time.time() < until and not {("a", "new", False), ("b", "x", False)} <= set(seen):
            time.sleep(0.5)
        assert set(seen) == {("a", "new", True), ("a", "new", False), ("b", "x", True), ("b", "x", False)}  # no input between
        store = lambda: spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/ck").count()
        until = time.time() + 60
        while time.time() < until and store():
            time.sleep(1)
        assert store() == 0
        events([("a", 1, "late")], "1")  # older than what was kept, which is gone
        until = time.time() + 60
        while time.time() < until and ("a", "late", True) not in seen:
            time.sleep(0.5)
        assert ("a", "late", True) in seen
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
