"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it as Parquet in the shared
folder and reads it again for the next one. All but the last return the columns of documents. A stage
works on every row that its predecessor kept. Null texts fail the quality rules; rows with a null id
are judged, deduplicated as documents and mixed, but their lines copy nothing and count as no one's copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, jaccard, lines, mixing, rules
from siltstone.llm.stored import stored
from siltstone.sources import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return rules.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that stand earlier; a document of nothing else goes."""
    left = lines.dedup_lines(docs.select(COLUMNS), whole=True).filter("n_removed < n_lines OR n_lines = 0")
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group; rows without an id come after all others. Different texts under one id are
    rows of their own; of rows that are equal in every column one stays."""
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64(*COLUMNS[1:]).alias("rest"))
    docs = docs.select(*COLUMNS, row.alias("row"))
    others = jaccard.ngram_jaccard_join(docs, "row").filter("row <> component_id").select("row").distinct()
    return docs.join(others, "row", "left_anti").dropDuplicates(["row"]).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: each document as often as it is taken."""
    return mixing.emit_copies(mixing.mix_sources(docs.select(COLUMNS))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row of the mix; ids are unsigned 32-bit integers."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(docs, ranks), ranks)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: An isolation forest and merge ranks are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
