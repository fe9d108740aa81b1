"""Intermediate tables in the folder that all executors share, and graph components over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import shared_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and there after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_in(df: DataFrame, columns: list[str], keys: DataFrame, bits: int = 23) -> DataFrame:
    """The rows of df whose columns a bitmap of 2**bits bits over the rows of keys doesn't rule out; the bitmap is broadcast and as large for any table."""
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set"))
    row = df.select(F.struct("*").alias("row"), place.alias("p"))
    near = row.join(F.broadcast(words), F.shiftright("p", 6).cast("int") == F.col("word"))
    return near.filter("shiftrightunsigned(set, cast(p & 63 as int)) & 1 = 1").select("row.*")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(src long, dst long) -> (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay the same; each round is a written
    table, so lineage stays short. Nodes on no edge are absent; self-loops and nulls are ignored.
    """
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct()
    now = stored(now, "edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        now = stored(small, "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
