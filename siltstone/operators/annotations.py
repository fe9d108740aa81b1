"""Annotations that follow their rows while the data changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import anchor_key, trimmed, usable_anchor

#: The marks that a memo begins with where what it says has not been checked.
UNVERIFIED = ("[未確認]", "[未読]", "[推測]", "[unverified]", "[inferred]")


def drifted(notes: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """notes(key, path, line_no, pinned) with status: kept, drifted, line_missing, file_gone, or skipped where no text was pinned."""
    now = lines.select("path", "line_no", F.col("text").alias("now"))
    held = files.select("path").distinct().withColumn("_file", F.lit(True))
    joined = notes.join(now, ["path", "line_no"], "left").join(held, "path", "left")
    status = F.when(F.col("pinned").isNull(), "skipped").when(F.col("_file").isNull(), "file_gone").when(F.col("now").isNull(), "line_missing")
    status = status.when(trimmed("now") == trimmed("pinned"), "kept").otherwise("drifted")
    return joined.withColumn("status", status).drop("_file", "now")


def heal_anchors(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """notes with new_line: the recorded line where it still matches, else the only line of the file that does, else null.

    Texts are compared with white space collapsed; a key of nothing but name characters is no anchor.
    Matches are counted over all lines of the file.
    """
    keyed = notes.withColumn("k", anchor_key("pinned"))
    wanted = keyed.filter(usable_anchor("k")).select("path", "k").distinct()
    same = lines.withColumn("k", anchor_key("text")).join(wanted, ["path", "k"], "left_semi")
    found = same.groupBy("path", "k").agg(F.count("*").alias("n"), F.min("line_no").alias("only"))
    here = same.select("path", "k", "line_no").withColumn("_here", F.lit(True))
    joined = keyed.join(found, ["path", "k"], "left").join(here, ["path", "k", "line_no"], "left")
    new = F.when(F.col("_here"), F.col("line_no")).when(F.col("n") == 1, F.col("only"))
    return joined.withColumn("new_line", new).select(*notes.columns, "new_line")


def unique_heal(notes: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """(key, path, line_no, new_line): drifted notes that may move to their only match, where no other note stands."""
    moved = heal_anchors(drifted(notes, lines, files).filter("status IN ('drifted', 'line_missing')").drop("status"), lines).filter("new_line IS NOT NULL AND new_line <> line_no")
    taken = notes.select("path", F.col("line_no").alias("new_line"))
    first = F.row_number().over(Window.partitionBy("path", "new_line").orderBy("key"))
    return moved.join(taken, ["path", "new_line"], "left_anti").withColumn("_k", first).filter("_k = 1").select("key", "path", "line_no", "new_line")


def _apply(at: Column, edit: Column) -> Column:
    """A line number after one edit: lines from from_line on move by delta; a delta below 0 takes away the lines just before from_line, and what stood there is null."""
    f, d = edit["from_line"], edit["delta"]
    inside = (d < 0) & (at >= f + d) & (at < f)
    return F.when(at.isNull() | inside, None).when(at >= f, at + d).otherwise(at)


def _edit_lists(edits: DataFrame) -> DataFrame:
    return edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "from_line", "delta"))).alias("edits"))


def _edits_or_none() -> Column:
    return F.coalesce("edits", F.array().cast("array<struct<seq:int,from_line:int,delta:int>>"))


def shift_points(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """notes with new_line and fate (moved, same, dropped) after all edits(path, seq, from_line, delta) of their file in order."""
    joined = notes.join(_edit_lists(edits), "path", "left")
    new = F.aggregate(_edits_or_none(), F.col("line_no"), _apply)
    fate = F.when(F.col("new_line").isNull(), "dropped").when(F.col("new_line") != F.col("line_no"), "moved").otherwise("same")
    return joined.withColumn("new_line", new).withColumn("fate", fate).drop("edits")


def _apply_range(at: Column, edit: Column) -> Column:
    """A range after one edit. Both ends taken away: none is left; the start alone: it begins where the rest moves to; the end alone: it ends before that; an edit inside moves the end."""
    s, e, f, d = at["s"], at["e"], edit["from_line"], edit["delta"]
    gone = lambda x: (d < 0) & (x >= f + d) & (x < f)
    pair = lambda x, y: F.struct(x.alias("s"), y.alias("e"))
    return (
        F.when(at.isNull() | (gone(s) & gone(e)), None)
        .when(gone(s), pair(f + d, e + d))
        .when(gone(e), pair(s, f + d - 1))
        .when(s >= f, pair(s + d, e + d))
        .when(e >= f, pair(s, F.greatest(s, e + d)))
        .otherwise(at)
    )


def shift_ranges(ranges: DataFrame, edits: DataFrame) -> DataFrame:
    """ranges(path, start_line, end_line) with new_start and new_end after all edits of their file in order; null where the range is dropped."""
    joined = ranges.join(_edit_lists(edits), "path", "left")
    start = F.struct(F.col("start_line").cast("int").alias("s"), F.col("end_line").cast("int").alias("e"))
    joined = joined.withColumn("_at", F.aggregate(_edits_or_none(), start, _apply_range))
    return joined.withColumn("new_start", F.col("_at.s")).withColumn("new_end", F.col("_at.e")).drop("_at", "edits")


def list_annotations(points: DataFrame, ranges: DataFrame, path: str | None = None, category: str | None = None) -> DataFrame:
    """(path, start_line, end_line, memo, category, source) of line and range memos together."""
    lines = points.select("path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), "memo", "category", F.lit("line").alias("source"))
    both = lines.unionByName(ranges.select("path", "start_line", "end_line", "memo", "category", F.lit("range").alias("source")))
    both = both.filter(F.col("path") == path) if path else both
    return both.filter(F.col("category") == category) if category else both


def upsert_annotations(old: DataFrame, new: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, path, line_no, memo, pinned): new rows replace old ones of their key; pinned text stays, and is taken from the lines for new keys only."""
    o = old.select("key", F.col("path").alias("op"), F.col("line_no").alias("ol"), F.col("memo").alias("om"), F.col("pinned").alias("opin")).withColumn("_old", F.lit(True))
    joined = o.join(new.select("key", "path", "line_no", "memo"), "key", "full").withColumn("path", F.coalesce("path", "op")).withColumn("line_no", F.coalesce("line_no", "ol"))
    text = lines.select("path", "line_no", F.col("text").alias("now"))
    joined = joined.join(text, ["path", "line_no"], "left")
    return joined.select("key", "path", "line_no", F.coalesce("memo", "om").alias("memo"), F.when(F.col("_old"), F.col("opin")).otherwise(F.col("now")).alias("pinned"))


def memo_join(lines: DataFrame, categories: DataFrame, sources: DataFrame, pins: DataFrame) -> DataFrame:
    """Four maps keyed `path::line`, each (key, value), as one table by full outer joins."""
    named = [d.select("key", F.col("value").alias(n)) for d, n in ((lines, "memo"), (categories, "category"), (sources, "source"), (pins, "pinned"))]
    out = named[0]
    for d in named[1:]:
        out = out.join(d, "key", "full")
    return out


def unverified(notes: DataFrame, tags: tuple = UNVERIFIED) -> DataFrame:
    """The notes whose memo begins, behind white space and whatever its case, with a mark of what is not checked."""
    memo = F.lower(F.regexp_replace("memo", r"^\s+", ""))
    hit = F.lit(False)
    for t in tags:
        hit = hit | memo.startswith(t.lower())
    return notes.filter(hit)


def digest(nodes: DataFrame, edges: DataFrame, notes: DataFrame, root: str, top: int = 10) -> DataFrame:
    """(item, label, n): counts of nodes, memos and rows outside the root, then the first roots with their memo (cut at 120) and children."""
    of = lambda df, item: df.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), F.lit("").alias("label"), "n")
    first = nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    kids = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n"))
    shown = first.orderBy("node").limit(top).join(kids, "node", "left").select(F.concat(F.lit("root:"), F.col("node").cast("string")).alias("item"), F.coalesce(F.substring("memo", 1, 120), F.lit("")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    outside = notes.filter(~F.lower("path").startswith(root.lower().rstrip("/") + "/"))
    parts = [of(nodes, "nodes"), of(notes, "line_memos"), of(unverified(notes), "unverified"), of(outside, "outside_root"), of(first, "roots_total"), shown]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def change_feed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key..., change): insert, update or delete between two snapshots; equal rows are silent."""
    values = [c for c in before.columns if c not in key]
    hashed = lambda df, name: df.select(*key, F.xxhash64(*values, *[F.col(v).isNull() for v in values]).alias(name))
    both = hashed(before, "b").join(hashed(after, "a"), key, "full")
    change = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*key, "change")
