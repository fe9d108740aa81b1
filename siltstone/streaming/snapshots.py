"""A table of rows by file whose commits are seen whole or not at all.

Rows lie in buckets of their path's hash, sorted by path. A commit writes the buckets that it touches anew,
under a version of its own, and then names the version of every bucket in a manifest, which appears by one
rename. Readers take the latest manifest, so they see all of a commit or nothing of it, and the files that they
read stay until vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: what a lookup of one path reads.
GROUP = 1 << 20


def _store(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which knows every store that Spark does."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    store, at = _store(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def manifest(spark: SparkSession, out: str, version: int | None = None) -> dict:
    """{version, batch, buckets, folders: bucket -> folder, schema} of the latest version, or of a given one; version 0 is the empty table."""
    versions = [int(n.split(".")[0]) for n in _names(spark, f"{out}/manifests") if n.endswith(".json")]
    version = max(versions, default=0) if version is None else version
    if not version:
        return {"version": 0, "batch": None, "buckets": None, "folders": {}, "schema": None}
    return json.loads(spark.read.text(f"{out}/manifests/{version:020d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, out: str, made: dict) -> None:
    """The manifest by a rename, which fails where another commit has taken the version."""
    store, side = _store(spark, f"{out}/manifests/.{uuid.uuid4().hex}")
    _, at = _store(spark, f"{out}/manifests/{made['version']:020d}.json")
    stream = store.create(side)
    stream.write(bytearray(json.dumps(made).encode()))
    stream.close()
    if store.exists(at) or not store.rename(side, at):
        store.delete(side, False)
        raise RuntimeError(f"version {made['version']} was committed by another writer")


def _bucket(path, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def commit(rows: DataFrame, out: str, gone: DataFrame | None = None, batch: int | None = None, buckets: int = 16) -> int:
    """Replace all rows of the paths in rows(path, ...) and drop those of gone(path); returns the version.

    batch: a number that grows; one that was committed already changes nothing, so a repeated batch is safe.
    The first commit fixes the number of buckets. A path in both keeps its new rows.
    """
    spark = rows.sparkSession
    before = manifest(spark, out)
    if batch is not None and before["batch"] is not None and batch <= before["batch"]:
        return before["version"]
    buckets = before["buckets"] or buckets
    named = rows.select("path").distinct()
    paths = named if gone is None else named.union(gone.select("path")).distinct()
    touched = [r[0] for r in paths.select(_bucket("path", buckets).alias("b")).distinct().collect()]  # `buckets` at most
    old = [before["folders"][str(b)] for b in touched if str(b) in before["folders"]]
    merged = rows
    if old:
        kept = spark.read.schema(before["schema"]).parquet(*(f"{out}/data/{f}" for f in old)).join(paths, "path", "left_anti")
        merged = kept.select(rows.columns).unionByName(rows)
    version, name = before["version"] + 1, uuid.uuid4().hex
    cells = merged.withColumn("bucket", _bucket("path", buckets)).repartition("bucket").sortWithinPartitions("bucket", "path")
    cells.write.option("parquet.block.size", GROUP).partitionBy("bucket").parquet(f"{out}/data/{name}")
    written = {n.split("=")[1] for n in _names(spark, f"{out}/data/{name}") if n.startswith("bucket=")}
    folders = {b: f for b, f in before["folders"].items() if int(b) not in touched} | {b: f"{name}/bucket={b}" for b in written}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    _publish(spark, out, {"version": version, "batch": before["batch"] if batch is None else batch, "buckets": buckets, "folders": folders, "schema": schema})
    return version


def current(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """The rows of the latest version, or of a given one; later commits don't change what was opened."""
    made = manifest(spark, out, version)
    if not made["schema"]:
        raise FileNotFoundError(f"nothing was committed to {out}")
    if not made["folders"]:
        return spark.createDataFrame([], made["schema"])
    return spark.read.schema(made["schema"]).parquet(*(f"{out}/data/{f}" for f in made["folders"].values()))


def lookup(spark: SparkSession, out: str, path: str) -> DataFrame:
    """The rows of one path: one bucket's files, of which the sorted row groups that may hold the path are read."""
    made = manifest(spark, out)
    if not made["schema"]:
        raise FileNotFoundError(f"nothing was committed to {out}")
    bucket = spark.range(1).select(_bucket(F.lit(path), made["buckets"])).first()[0]
    folder = made["folders"].get(str(bucket))
    if folder is None:
        return spark.createDataFrame([], made["schema"])
    return spark.read.schema(made["schema"]).parquet(f"{out}/data/{folder}").filter(F.col("path") == path)


def snapshot_sink(out: str, deleted: str = "deleted", buckets: int = 16):
    """A foreachBatch function: rows whose `deleted` is true take their path's rows away, the others replace them."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        flag = F.coalesce(F.col(deleted), F.lit(False))
        commit(batch.filter(~flag).drop(deleted), out, batch.filter(flag).select("path"), number, buckets)
        batch.unpersist()

    return write


def vacuum(spark: SparkSession, out: str, keep: int = 2) -> int:
    """Deletes manifests but the last `keep`, and data that none of these names; returns how many data folders went."""
    numbers = [n for n in _names(spark, f"{out}/manifests") if n.endswith(".json")]
    used = {f for n in numbers[-keep:] for f in manifest(spark, out, int(n.split(".")[0]))["folders"].values()}
    for n in numbers[:-keep]:
        store, at = _store(spark, f"{out}/manifests/{n}")
        store.delete(at, False)
    removed = 0
    for name in _names(spark, f"{out}/data"):
        for part in _names(spark, f"{out}/data/{name}"):
            if part.startswith("bucket=") and f"{name}/{part}" not in used:
                store, at = _store(spark, f"{out}/data/{name}/{part}")
                store.delete(at, True)
                removed += 1
    return removed
