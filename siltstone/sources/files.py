"""Files, tag files, cross-reference dumps, project JSON and the saved reference map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.columns import path_ext
from siltstone.functions.patterns import include_condition
from siltstone.operators.search import exclude, explode_lines, search

BINARY = (".o", ".a", ".so", ".exe", ".dll", ".png", ".jpg", ".gif", ".pdf", ".zip", ".gz", ".jar", ".class", ".bin")
MOST_BYTES = 10 << 20
#: The one-letter kinds of tag files; other letters stay as they are.
TAG_KINDS = {"f": "func", "s": "struct", "u": "union", "e": "enum_member", "g": "enum", "d": "define", "t": "typedef", "m": "member", "v": "var"}
MAP_VERSION = 1

PROJECT = ("trees array<struct<id:string,name:string>>, nodes array<struct<id:string,path:string,line_no:int,label:string,memo:string,tree_id:string>>, edges array<struct<src:string,dst:string,label:string>>, line_memos map<string,string>, line_categories map<string,string>, line_sources map<string,string>, line_pins map<string,string>, range_memos array<struct<id:string,path:string,start_line:int,end_line:int,memo:string,category:string,source:string>>")


def scan_files(spark: SparkSession, root: str, globs: str = "", rules: str = "") -> DataFrame:
    """(path, content, mtime, length) below root by include globs minus exclusion rules, paths relative to root, each once. The size bound is applied before contents are read; Spark lists no row for an empty file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split(":", 1)[-1].replace("\\", "/").strip("/")
    rel = F.substring_index("path", base + "/", -1)
    files = found.filter(F.col("length") <= MOST_BYTES).select(rel.alias("path"), "content", F.col("modificationTime").alias("mtime"), "length").dropDuplicates(["path"])
    files = files.filter(include_condition(globs))
    return exclude(files, rules) if rules else files


def oversized_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files that scan_files passes over for their size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.filter(F.col("length") > MOST_BYTES).select("path", "length")


def drop_binary(files: DataFrame) -> DataFrame:
    """Without files of a binary extension or with a NUL in the first 512 bytes, unless a UTF-16 mark leads."""
    head = F.hex(F.substring("content", 1, 512))
    nul = F.exists(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(head) / 2).cast("int")), lambda i: F.substring(head, i * 2 - 1, F.lit(2))), lambda b: b == "00")
    return files.filter(~path_ext("path").isin(*BINARY) & (~nul | head.startswith("FFFE") | head.startswith("FEFF")))


def _legacy(data: bytes) -> tuple[str, str | None]:
    """UTF-16 where its mark leads, else Shift-JIS or EUC-JP, whichever reads with fewer marks of error; unknown where both are mostly errors."""
    for mark, codec, name in ((b"\xff\xfe", "utf-16-le", "UTF16LE"), (b"\xfe\xff", "utf-16-be", "UTF16BE")):
        if data.startswith(mark):
            return name, data[2:].decode(codec, "replace")
    tried = [(data.decode(codec, "replace"), name) for codec, name in (("cp932", "SJIS"), ("euc_jp", "EUCJP"))]
    text, name = min(tried, key=lambda t: t[0].count("�"))
    return ("UNKNOWN", None) if 2 * text.count("�") > max(len(text), 1) else (name, text)


def decode_text(files: DataFrame) -> DataFrame:
    """files with encoding, text and non_utf8: marks first, then valid UTF-8; only the rest goes to a pandas UDF."""

    @F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
    def legacy(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_legacy(bytes(d)) if d is not None else ("UNKNOWN", None) for d in data], columns=["encoding", "text"])

    head = F.hex(F.substring("content", 1, 3))
    kind = F.when(head == "EFBBBF", "UTF8_BOM").when(head.startswith("FFFE") | head.startswith("FEFF"), None).when(F.length("content") == 0, "UNKNOWN").when(F.is_valid_utf8(F.col("content").cast("string")), "UTF8")
    marked = files.withColumn("encoding", kind)
    text = F.when(F.col("encoding") == "UTF8", F.col("content").cast("string")).when(F.col("encoding") == "UTF8_BOM", F.expr("cast(substring(content, 4, length(content)) as string)"))
    known = marked.filter("encoding IS NOT NULL").withColumn("text", text)
    rest = marked.filter("encoding IS NULL").withColumn("d", legacy("content")).withColumn("encoding", F.col("d.encoding")).withColumn("text", F.col("d.text")).drop("d")
    return known.unionByName(rest).withColumn("non_utf8", ~F.col("encoding").isin("UTF8", "UTF8_BOM"))


def decode_as(files: DataFrame, encoding: str) -> DataFrame:
    """files(path, content binary) as (path, content string) under a given encoding, whatever the bytes look like: utf-8, utf-16le, utf-16be, sjis or euc-jp."""
    name = encoding.lower().replace("_", "-")
    if name == "utf-8":
        text = F.col("content").cast("string")
    else:
        codec = {"utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "sjis": "cp932", "shift-jis": "cp932", "euc-jp": "euc_jp"}[name]

        @F.pandas_udf(T.StringType())
        def text_of(data: pd.Series) -> pd.Series:
            return pd.Series([None if d is None else bytes(d).decode(codec, "replace") for d in data], dtype=object)

        text = text_of("content")
    return files.select("path", text.alias("content"))


def search_encoded(files: DataFrame, encoding: str, pattern: str, **options) -> DataFrame:
    """(path, line_no, text): lines of files(path, content binary) that match, read under a given encoding."""
    return search(explode_lines(decode_as(files, encoding)), pattern, **options)


def tag_kind(letter) -> Column:
    """The kind that a tag file's letter stands for; null for none."""
    kinds = F.create_map(*[F.lit(x) for pair in TAG_KINDS.items() for x in pair])
    return F.when(letter != "", F.coalesce(F.try_element_at(kinds, letter), letter))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, line_no, kind, text) of a tag file; rows that start with `!` are skipped."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("!") & F.col("value").contains("\t"))
    front, ext = F.substring_index("value", ';"\t', 1), F.when(F.col("value").contains(';"\t'), F.substring_index("value", ';"\t', -1)).otherwise("")
    name, file = F.regexp_extract(front, r"^([^\t]*)\t([^\t]*)\t", 1), F.regexp_extract(front, r"^([^\t]*)\t([^\t]*)\t", 2)
    address = F.regexp_replace(front, r"^[^\t]*\t[^\t]*\t", "")
    letter = F.regexp_extract(ext, r"(?:^|\t)(?:kind:)?([A-Za-z])(?:\t|$)", 1)
    line = F.coalesce(F.regexp_extract(ext, r"line:(\d+)", 1).try_cast("int"), F.regexp_extract(address, r"^(\d+)", 1).try_cast("int"))
    return rows.select(name.alias("name"), file.alias("path"), line.alias("line_no"), tag_kind(letter).alias("kind"), F.nullif(F.regexp_extract(address, r"^/\^?(.*?)\$?/$", 1), F.lit("")).alias("text"))


def read_xref(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(name, line_no, path, text, kind) of `symbol line path text` rows; rows without a text count for references only."""
    parts = F.split(F.trim("value"), r"\s+", 4)
    rows = spark.read.text(path).withColumn("p", parts).filter(F.size("p") >= (3 if kind == "ref" else 4))
    return rows.select(F.col("p")[0].alias("name"), F.col("p")[1].try_cast("int").alias("line_no"), F.col("p")[2].alias("path"), F.get("p", 3).alias("text"), F.lit(kind).alias("kind"))


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a project file: trees, nodes, edges, line_notes and range_notes; absent parts are empty."""
    raw = spark.read.schema(PROJECT).json(path, multiLine=True, mode="PERMISSIVE")
    rows = lambda c: raw.select(F.explode(c).alias("r")).select("r.*")
    maps = {"memo": "line_memos", "category": "line_categories", "source": "line_sources", "pinned": "line_pins"}
    notes = None
    for name, c in maps.items():
        part = raw.select(F.explode(c).alias("key", name))
        notes = part if notes is None else notes.join(part, "key", "full")
    return {"trees": rows("trees"), "nodes": rows("nodes"), "edges": rows("edges"), "line_notes": notes, "range_notes": rows("range_memos")}


def write_project(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of read_project as one project file: a JSON object, which one person's notes fit in. Absent tables are empty."""
    spark = next(iter(tables.values())).sparkSession
    kinds = T._parse_datatype_string(PROJECT)
    row = spark.range(1)
    for name in ("trees", "nodes", "edges", "range_notes"):
        kind = kinds["range_memos" if name == "range_notes" else name].dataType
        held = tables.get(name, spark.createDataFrame([], kind.elementType))
        fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.elementType])
        row = row.crossJoin(held.agg(F.array_sort(F.collect_list(fields)).alias("range_memos" if name == "range_notes" else name)))  # one row each
    notes = tables.get("line_notes", spark.createDataFrame([], "key string, memo string, category string, source string, pinned string"))
    for column, name in (("memo", "line_memos"), ("category", "line_categories"), ("source", "line_sources"), ("pinned", "line_pins")):
        pairs = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("key", column))))
        row = row.crossJoin(notes.agg(F.map_from_entries(pairs).alias(name)))
    row.drop("id").coalesce(1).write.mode("overwrite").json(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_refmap(edges: DataFrame, path: str, index_mtime: int, size: int, rules: str) -> None:
    """The file edges and a one-row manifest that says what they were made from."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = edges.sparkSession
    spark.range(1).select(F.lit(MAP_VERSION).alias("version"), F.lit(index_mtime).cast("long").alias("mtime"), F.lit(size).cast("long").alias("size"), F.xxhash64(F.lit(rules)).alias("rules")).write.mode("overwrite").parquet(f"{path}/manifest")


def load_refmap(spark: SparkSession, path: str, index_mtime: int, size: int, rules: str) -> DataFrame | None:
    """The saved edges, or None where the manifest doesn't match; nothing is built again in silence."""
    want = spark.range(1).select(F.lit(MAP_VERSION).alias("version"), F.lit(index_mtime).cast("long").alias("mtime"), F.lit(size).cast("long").alias("size"), F.xxhash64(F.lit(rules)).alias("rules")).first()
    try:
        have = spark.read.parquet(f"{path}/manifest").first()
    except Exception as e:  # no saved map
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return spark.read.parquet(f"{path}/edges") if have == want else None
