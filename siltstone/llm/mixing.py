"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def size_in_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target): shares by weight of share_percent of all sizes, none above most times its source.

    Sources come in code-point order, null last; weights repeat over them. What a full source can't
    take is shared again by weight, which ends at the level where capped sources hold most times
    their size and the rest hold their weight times one factor. The windows run over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    per = per.withColumn("all", F.sum("source_size").over(every) * F.lit(share_percent / 100)).withColumn("w_all", F.sum("w").over(every))
    per = per.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    left = (F.col("all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    per = per.withColumn("left", left).withColumn("full", F.col("left") * F.col("w") >= F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("left")))).over(every)["left"]
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share_percent: int = 150, most: int = 2, seed: str = "mix", buckets: int = 256) -> DataFrame:
    """docs with the struct column mix(size, source_size, target, copies).

    Expected copies of a document are target / source_size of its source. Documents stand in an order
    of size class, id bucket, size and id; their expected copies are summed along it, one offset in
    [0, 1) from md5(seed, source) is added, and a document is taken once for each whole number it
    crosses, so at most `most` times. The place in the order is the place within its (source, class,
    bucket) cell plus the rows of the cells before; only cell counts, at most 64 * 16 * buckets a
    source, meet in one window, so a hot source is not sorted in one task. Same input, same result.

    Whole-number ids are dealt to buckets as they are, others by their hash and null ones by that of their
    text, which also ends the order of rows of one size and id. Null text counts 0 words and may be taken 0 words at a time; a source of 0 words has target 0 and
    no copies. A null source is a source. Repeated rows count each. Extra columns stay, but for one
    named mix. An empty table gives an empty one.
    """
    # the caller's row travels as one struct, so that no name of its can clash
    sized = docs.drop("mix").select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_in_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    log = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")
    # four bits below the leading one split each power of two in sixteen classes
    sized = sized.withColumn("class", log * 16 + F.least(F.lit(15), F.floor((F.col("size") / F.pow(F.lit(2.0), log) - 1) * 16)).cast("int"))
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    number = F.coalesce(F.col("id").cast("long") if whole else F.when(F.col("id").isNotNull(), F.xxhash64("id")), F.col("tie"))
    sized = sized.withColumn("bucket", F.pmod(number, F.lit(buckets)).cast("int"))
    cells = sized.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    targets = source_targets(cells.select("source", F.col("s").alias("size")), weights, share_percent, most)
    run = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n", "s")
    cells = _with_targets(cells, targets)
    cell = Window.partitionBy("source", "class", "bucket").orderBy("size", "id", "tie")
    a, b = sized.withColumn("rank", F.row_number().over(cell)).alias("a"), cells.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.bucket") == F.col("b.bucket"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("a.source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("b.source_size") > 0, F.col("b.target") / F.col("b.source_size")).otherwise(F.lit(0.0))
    place = F.col("b.before") + F.col("a.rank")
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    mix = F.struct(F.col("a.size").alias("size"), F.col("b.source_size").alias("source_size"), F.col("b.target").alias("target"), F.least(copies, F.lit(most)).cast("long").alias("copies"))
    return a.join(b, same, "left").select(F.col("a.row").alias("row"), mix.alias("mix")).select("row.*", "mix")


def _with_targets(cells: DataFrame, targets: DataFrame) -> DataFrame:
    a, b = cells.alias("a"), targets.alias("b")
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "b.source_size", "b.target")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    copies = F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))
    return mixed.filter("mix.copies > 0").select(F.struct("*").alias("row"), copies).select("row.*").drop("mix")
