"""Definitions and references: joins of names, positions and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import common_segments, normalize_path, path_base, path_dir, path_ext, path_prefixes, path_stem, path_suffixes, strip_line_comment
from siltstone.operators.joins import merged
from siltstone.operators.walks import closures

IMPLEMENTATION = (".c", ".cc", ".cpp", ".cxx")
HEADERS = (".h", ".hh", ".hpp", ".hxx")


def definitions(words: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols of the wanted names; Spark broadcasts whichever side its statistics show to be small."""
    return symbols.join(words.select("name").distinct(), "name", "left_semi")


def first_engine(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first source, in order, that has any for a name, with engine."""
    every = None
    for i, (engine, df) in enumerate(sources):
        df = df.withColumn("engine", F.lit(engine)).withColumn("_p", F.lit(i))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    best = F.min("_p").over(Window.partitionBy("name"))
    return every.withColumn("_best", best).filter("_p = _best").drop("_p", "_best")


def is_declaration(text, after) -> Column:
    """`;` before any `{` in a line and those after it."""
    both = F.concat_ws("\n", text, after)
    end, brace = F.instr(both, ";"), F.instr(both, "{")
    return (end > 0) & ((brace == 0) | (end < brace))


def prefer_definitions(defs: DataFrame) -> DataFrame:
    """defs(name, kind, path, is_def): definitions over declarations of a name, then implementation files over headers within a kind."""
    has_def = F.max(F.col("is_def").cast("int")).over(Window.partitionBy("name"))
    kept = defs.withColumn("_d", has_def).filter((F.col("_d") == 0) | F.col("is_def"))
    impl = path_ext("path").isin(*IMPLEMENTATION)
    has_impl = F.max(impl.cast("int")).over(Window.partitionBy("name", "kind"))
    return kept.withColumn("_i", has_impl).filter((F.col("_i") == 0) | impl).drop("_d", "_i")


def nearest_definition(words: DataFrame, symbols: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """words(name, current) with the definitions at the first level that holds one: the own folder, then each folder above, the root last.

    symbols(name, path, is_def). Levels before the root count only definitions; the root takes declarations
    too. closure(current, path): the files that each file includes, directly or not, and its sibling sources;
    definitions there come before all levels, as level -1.
    """
    words = words.filter("name IS NOT NULL AND current IS NOT NULL")
    defined = symbols.filter("is_def AND path IS NOT NULL")
    columns = [*words.columns, *(c for c in symbols.columns if c != "name"), "level"]
    near = None
    if closure is not None:
        inside = merged(closure.select("current", "path").distinct(), defined, "path")
        near = merged(words, inside, ["name", "current"]).withColumn("level", F.lit(-1)).select(columns)
        words = merged(words, near.select("name", "current").distinct(), ["name", "current"], "left_anti")
    folders = lambda c: F.posexplode(path_prefixes(c)).alias("_n", "_folder")
    # the deepest folder above a word that holds a definition, by names and folders; rows meet in that one only
    held = defined.select("name", path_dir("path").alias("_dir")).distinct().select("name", folders("_dir")).distinct()
    asked = words.select("name", path_dir("current").alias("_dir")).distinct()
    deepest = merged(asked.select("name", "_dir", folders("_dir")), held, ["name", "_n", "_folder"]).groupBy("name", "_dir").agg(F.max(F.struct("_n", "_folder")).alias("_at"))
    placed = merged(words.withColumn("_dir", path_dir("current")), deepest, ["name", "_dir"], "left").withColumn("_own", F.size(F.split("_dir", "/")))
    below = defined.withColumn("_dir", path_dir("path")).select(*symbols.columns, folders("_dir"))
    found = merged(placed.filter("_at IS NOT NULL").select(*words.columns, "_own", "_at._n", "_at._folder"), below, ["name", "_n", "_folder"])
    root = merged(placed.filter("_at IS NULL"), symbols, "name")
    out = found.withColumn("level", (F.col("_own") - F.col("_n") - 1).cast("int")).select(columns).unionByName(root.withColumn("level", F.col("_own")).select(columns))
    return out if near is None else near.unionByName(out)


#: Words before a parenthesis that name no function.
NOT_NAMES = ("if", "else", "while", "for", "switch", "return", "sizeof", "typeof", "alignof", "defined", "offsetof", "case", "do", "catch", "throw", "new", "delete")


def definition_body(text) -> Column:
    return F.trim(strip_line_comment(text))


def header_verdict(body) -> Column:
    """Whether a header's own line defines (true) or declares (false); null where it doesn't tell."""
    return F.when(body.endswith(";"), False).when(body.contains("{"), True)


def later_verdict(body) -> Column:
    """The same of a line behind it."""
    return F.when(body.contains("{"), True).when(body.endswith(";"), False)


def judge_definitions(hits: DataFrame, lines: DataFrame, ahead: int = 20) -> DataFrame:
    """hits(name, kind, path, line_no, ...) with is_def, wrong_name and annotation; lines(path, line_no, text) of their files.

    All kinds but func define. A function's line that ends in `;` declares, one with `{` defines, and of up to
    `ahead` lines after it the first of either kind decides; where none does, it defines. wrong_name: the
    first name before a parenthesis of a defining line is another one. annotation: a defining line without
    `{` behind which, within three lines, the first with a text is a name and a parenthesis. Only the lines
    at and after hits are joined, by place.
    """
    asked = hits.select("path", "line_no").filter("path IS NOT NULL AND line_no IS NOT NULL").distinct().select("path", F.col("line_no").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(ahead))).alias("k"))
    near = merged(asked, lines.select("path", F.col("line_no").alias("_n"), "text"), (F.col("_n") == F.col("at") + F.col("k")) & (asked["path"] == lines["path"])).select(asked["path"], "at", "k", F.trim("text").alias("full"), definition_body("text").alias("code"))
    first = lambda c, v: F.min(F.when(c, F.struct("k", v.alias("v"))))["v"]
    said = F.when(F.col("k") == 0, header_verdict(F.col("code"))).otherwise(later_verdict(F.col("code")))
    facts = near.groupBy("path", F.col("at").alias("line_no")).agg(
        first(said.isNotNull(), said).alias("_def"),
        F.max(F.when(F.col("k") == 0, F.col("full"))).alias("_line"),
        first(F.col("k").between(1, 3) & (F.col("full") != ""), F.col("full")).alias("_next"),
    )
    return judged_definitions(merged(hits, facts, ["path", "line_no"], "left")).select(*hits.columns, "is_def", "wrong_name", "annotation")


def judged_definitions(hits: DataFrame) -> DataFrame:
    """judge_definitions() of hits that know _def, what the lines said, _line, their own line, and _next, the first with a text behind it."""
    func = F.col("kind") == "func"
    is_def = F.coalesce(~func | F.coalesce("_def", F.lit(True)), F.lit(True))
    called = F.filter(F.regexp_extract_all("_line", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)), lambda n: ~n.isin(*NOT_NAMES))
    other = F.coalesce(func & is_def & (F.get(called, F.lit(0)) != F.col("name")), F.lit(False))
    bare = ~F.col("_line").contains("{") & ~F.col("_line").endswith(";")
    note = F.coalesce(func & is_def & bare & F.col("_next").rlike(r"^[A-Za-z_]\w*\s*\("), F.lit(False))
    return hits.select("*", is_def.alias("is_def"), other.alias("wrong_name"), note.alias("annotation"))


def choose_definitions(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """prefer_definitions() of what judge_definitions() leaves: rows of a wrong name go, and a line of annotations counts as no definition."""
    judged = judge_definitions(hits, lines).filter("NOT wrong_name")
    return prefer_definitions(judged.withColumn("is_def", F.col("is_def") & ~F.col("annotation")).drop("wrong_name", "annotation"))


def dependency_graph(edges: DataFrame, max_nodes: int = 100, max_edges: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes(id, label), edges(src, dst), one row (nodes, edges, truncated)): the graph to show, its least nodes and edges where there are more."""
    every = edges.select("src", "dst").distinct()
    ends = every.select(F.col("src").alias("id")).union(every.select("dst")).distinct()
    sizes = ends.agg(F.count("*").alias("nodes")).crossJoin(every.agg(F.count("*").alias("edges")))  # one row each
    sizes = sizes.withColumn("truncated", (F.col("nodes") > max_nodes) | (F.col("edges") > max_edges))
    return ends.orderBy("id").limit(max_nodes).select("id", path_base("id").alias("label")), every.orderBy("src", "dst").limit(max_edges), sizes


def include_closure(includes: DataFrame, currents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(current, path): the files that each file of currents(current) includes, directly or not; of includes(src, dst).

    With files(path), the sources beside the headers among them, and beside the file itself if it is a
    header, are of the closure too.
    """
    near = closures(includes, currents.select(F.col("current").alias("start"))).select(F.col("start").alias("current"), F.col("node").alias("path"))
    if files is None:
        return near
    headers = near.unionByName(currents.select("current", F.col("current").alias("path"))).distinct().filter(path_ext("path").isin(*HEADERS))
    beside = sibling_sources(headers.select("path").distinct(), files)
    sources = headers.join(beside.withColumnRenamed("header", "path"), "path").select("current", F.col("source").alias("path"))
    return near.unionByName(sources).distinct()


def enclosing_function(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits(path, line_no, ...) with func and func_line: the innermost span around each line; null outside.

    Spans of a file nest or stand apart. Begins, ends and hits stand in one order by file and line; a
    running sum gives the depth, and the innermost span of a hit is the last one that began at its
    depth: two windows, and no join on ranges.
    """
    at = hits.schema["line_no"].dataType
    # both ends of a span come from one reading: a union of begins and ends would find the spans twice
    edge = lambda line, order, tie, delta, span: F.struct(line.cast(at).alias("line_no"), F.lit(order).alias("_order"), tie.cast("long").alias("_tie"), F.lit(delta).alias("_delta"), span.alias("_span"))
    span = F.struct("name", "start_line")
    begin = edge(F.col("start_line"), 1, -F.col("end_line"), 1, span)
    end = edge(F.col("end_line") + 1, 0, F.lit(0), -1, F.when(F.lit(False), span))
    edges = spans.select("path", F.explode(F.array(begin, end)).alias("_e")).select("path", "_e.*")
    asked = hits.withColumns({"_order": F.lit(2), "_tie": F.lit(0).cast("long"), "_delta": F.lit(0)})
    run = Window.partitionBy("path").orderBy("line_no", "_order", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = asked.unionByName(edges, allowMissingColumns=True).withColumn("_depth", F.sum("_delta").over(run))
    last = Window.partitionBy("path", "_depth").orderBy("line_no", "_order", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = depth.withColumn("_inner", F.when(F.col("_depth") > 0, F.last("_span", ignorenulls=True).over(last))).filter("_order = 2")
    return found.select(*hits.columns, F.col("_inner.name").alias("func"), F.col("_inner.start_line").alias("func_line"))


def resolve_includes(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of edges(src, target, quoted): a quoted target is relative to its file, an angled one any header's path end, the least such path; others are dropped."""
    known = files.select("path").distinct()
    quoted = edges.filter("quoted").select("src", normalize_path(F.concat_ws("/", F.nullif(path_dir("src"), F.lit("")), F.col("target"))).alias("path"))
    near = quoted.join(known, "path").select("src", F.col("path").alias("dst"))
    ends = known.filter(path_ext("path").isin(*HEADERS)).select("path", F.explode(path_suffixes("path")).alias("target")).groupBy("target").agg(F.min("path").alias("dst"))
    far = edges.filter("NOT quoted").join(ends, "target").select("src", "dst")
    return near.unionByName(far).distinct()


def include_edges(lines: DataFrame) -> DataFrame:
    """edges(src, target, quoted) of #include lines."""
    at = r'^\s*#\s*include\s*(["<])([^">]+)[">]'
    return lines.filter(F.col("text").rlike(at)).select(F.col("path").alias("src"), F.regexp_extract("text", at, 2).alias("target"), (F.regexp_extract("text", at, 1) == '"').alias("quoted"))


def included_by(resolved: DataFrame, basename: str) -> DataFrame:
    return resolved.filter(path_base("dst") == basename).select("dst", "src")


#: Kinds that can't be called.
NON_CALLABLE = ("struct", "union", "enum", "enumerator", "enum_member", "typedef", "member", "field")


def rank_callee_definition(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges(caller_path, callee) with the best definition, how many there are, and the confidence in it.

    Score: func 100, define 50, an implementation file 10, a header 5, the same folder 1000, else 100
    for each leading segment shared. confidence: low without a definition; high for one candidate, a
    score of 1000, or a lead of 100; medium for a score of 100; else low. likely_macro: no definition
    or defines only; likely_non_callable: definitions of kinds only that can't be called.
    """
    symbols = symbols.withColumnRenamed("name", "callee")
    shown = [c for c in symbols.columns if c != "callee"]
    only = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    facts = symbols.groupBy("callee").agg(F.count("path").alias("candidates"), only(F.col("kind") == "define").alias("_defines"), only(F.col("kind").isin(*NON_CALLABLE)).alias("_fixed"), F.min_by(F.struct(*shown), "path").alias("_first"))
    kind = F.when(F.col("kind") == "func", 100).when(F.col("kind") == "define", 50).otherwise(0)
    ext = F.when(path_ext("path").isin(*IMPLEMENTATION), 10).when(path_ext("path").isin(*HEADERS), 5).otherwise(0)
    rated = symbols.filter("path IS NOT NULL").withColumn("_base", kind + ext).withColumn("_dir", path_dir("path"))
    # Two definitions of a folder may be the best two of a call, and with two more of other folders, should these be the
    # call's own, the best four below each folder hold the best two of all calls that share it: no call meets every definition.
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_base"), "path"))
    rated = rated.withColumn("_r", first("callee", "_dir")).filter("_r <= 2")
    # a call meets its own folder, the root, and each folder above
    folders = lambda c: F.explode(F.concat(F.array(F.concat(F.lit("="), c), F.lit("")), F.transform(path_prefixes(c), lambda p: F.concat(F.lit("/"), p)))).alias("_folder")
    best = rated.select("*", folders("_dir")).withColumn("_k", first("callee", "_folder")).filter("_k <= 4").drop("_k")
    calls = edges.dropDuplicates(["caller_path", "callee"]).withColumn("_from", path_dir("caller_path"))
    met = merged(calls.select("callee", "_from").distinct().select("callee", "_from", folders("_from")), best, ["callee", "_folder"]).dropDuplicates(["callee", "_from", "_dir", "_r"])
    near = F.when(F.col("_dir") == F.col("_from"), 1000).otherwise(100 * common_segments("_from", "_dir"))
    met = met.withColumn("score", F.col("_base") + near)
    by = Window.partitionBy("callee", "_from").orderBy(F.desc("score"), "path")
    met = met.withColumn("_k", F.row_number().over(by)).withColumn("gap", F.col("score") - F.lead("score").over(by)).filter("_k = 1")
    joined = merged(merged(calls, met.select("callee", "_from", F.struct(*shown).alias("_best"), "score", "gap"), ["callee", "_from"], "left"), facts, "callee", "left")
    joined = joined.withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long"))).withColumn("_best", F.coalesce("_best", "_first"))
    joined = joined.withColumn("likely_macro", (F.col("candidates") == 0) | F.col("_defines")).withColumn("likely_non_callable", (F.col("candidates") > 0) & F.col("_fixed"))
    sure = (F.col("candidates") == 1) | (F.col("score") >= 1000) | (F.col("gap") >= 100)
    confidence = F.when(F.col("candidates") == 0, "low").when(sure, "high").when(F.col("score") >= 100, "medium").otherwise("low")
    return joined.select(*edges.columns, *(F.col(f"_best.{c}").alias(c) for c in shown), "score", "candidates", "likely_macro", "likely_non_callable", confidence.alias("confidence"))


def callee_kinds(callees: DataFrame, symbols: DataFrame) -> DataFrame:
    """callees(name, ...) with kind; unknown names stay with a null kind."""
    return merged(callees, symbols.groupBy("name").agg(F.min("kind").alias("kind")), "name", "left")


def sibling_sources(headers: DataFrame, files: DataFrame) -> DataFrame:
    """(header, source): files of another kind with the header's stem."""
    h = headers.select(F.col("path").alias("header"), path_stem("path").alias("stem"))
    s = files.filter(path_ext("path").isin(*IMPLEMENTATION)).select(F.col("path").alias("source"), path_stem("path").alias("stem"))
    return h.join(s, "stem").select("header", "source")


def in_subtree(a, b) -> Column:
    """Whether one of two folders holds the other."""
    x, y = F.concat(F.col(a), F.lit("/")), F.concat(F.col(b), F.lit("/"))
    return x.startswith(y) | y.startswith(x)


def subtree_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a(name, folder, ...) and b(name, folder, ...) of one name where one's folder is or holds the other's, as in in_subtree().

    A folder meets those above it by their paths, so that only pairs of the answer meet.
    """
    under = lambda df: df.withColumn("_own", F.col("folder")).withColumn("folder", F.explode(F.array_union(F.array("folder"), path_prefixes("folder"))))
    left = merged(under(a), b, ["name", "folder"])
    right = merged(a, under(b).filter("folder <> _own"), ["name", "folder"])
    return left.drop("_own", "folder").unionByName(right.drop("_own", "folder"))


def stale_files(files: DataFrame, indexed_at: Column) -> DataFrame:
    """(n_stale, newest) of files(path, mtime) newer than the index."""
    return files.filter(F.col("mtime") > indexed_at).agg(F.count("*").alias("n_stale"), F.max("mtime").alias("newest"))


def regather(refs: DataFrame, stale: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """refs(name, path, line_no) with those of stale files replaced by what their lines hold now, all of it; #define lines of the name don't count."""
    fresh = lines.join(stale.select("path").distinct(), "path", "left_semi").select("path", "line_no", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("name"))
    fresh = fresh.join(names.select("name").distinct(), "name", "left_semi").filter(F.regexp_extract("text", r"^\s*#\s*define\s+(\w+)", 1) != F.col("name"))
    fresh = fresh.select("name", "path", "line_no")
    return refs.join(stale.select("path").distinct(), "path", "left_anti").select("name", "path", "line_no").unionByName(fresh)


def compare_callers_refs(callers: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, line_no, in_callers, in_refs): a full outer join of the two answers."""
    a = callers.select("path", "line_no").distinct().withColumn("a", F.lit(True))
    b = refs.select("path", "line_no").distinct().withColumn("b", F.lit(True))
    return a.join(b, ["path", "line_no"], "full").select("path", "line_no", F.coalesce("a", F.lit(False)).alias("in_callers"), F.coalesce("b", F.lit(False)).alias("in_refs"))


def group_refs(sites: DataFrame, key: str, sample: int = 2) -> DataFrame:
    """(key, n, samples): sites(path, line_no, ...) by a key with the first places; a null key is `(none)`."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("(none)"))
    place = F.struct("path", "line_no")
    rows = sites.withColumn("_k", F.row_number().over(Window.partitionBy(k).orderBy("path", "line_no"))).withColumn("key", k)
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= sample, place)))
    return rows.groupBy("key").agg(F.count("*").alias("n"), first.alias("s")).select("key", "n", F.transform("s", lambda x: F.concat(x["path"], F.lit(":"), x["line_no"].cast("string"))).alias("samples"))


def group_refs2(sites: DataFrame, outer: str, inner: str, most: int = 40) -> DataFrame:
    """(outer, inner, file, n, lines, truncated): all lines up to `most` under each inner key; file is empty where it is mixed."""
    by = Window.partitionBy(outer, inner).orderBy("line_no", "path")
    rows = sites.withColumn("_k", F.row_number().over(by))
    one = F.when(F.min("path") == F.max("path"), F.min("path")).otherwise(F.lit(""))
    return rows.groupBy(F.col(outer).alias("outer"), F.col(inner).alias("inner")).agg(one.alias("file"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col("line_no")))).alias("lines"), (F.count("*") > most).alias("truncated"))


def callers_dedup(sites: DataFrame, word: str | None = None) -> DataFrame:
    """One row a file and function at its first call, one a line at file scope; a function's calls of itself go."""
    rows = sites.filter(F.col("func").isNull() | (F.col("func") != word)) if word else sites
    inside = rows.filter("func IS NOT NULL").groupBy("path", "func").agg(F.min("line_no").alias("line_no"))
    outside = rows.filter("func IS NULL").select("path", "func", "line_no").distinct()
    return inside.unionByName(outside.select("path", "func", "line_no"))
