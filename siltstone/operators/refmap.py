"""The reference map: which file refers to which, folded by folders, with what was left out counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import group_prefix, path_prefixes

SAMPLE = 8


def part_files(part: DataFrame) -> DataFrame:
    """symbols(name, path, is_static, is_header) of parts read as files."""
    path = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/part_"), F.col("p_partkey").cast("string"))
    name = F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"))
    return part.select("p_partkey", name.alias("name"), path.alias("path"), (F.col("p_size") % 10 == 0).alias("is_static"), (F.col("p_size") < 3).alias("is_header"))


def part_refs(lineitem: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs(path, is_header, name): in an order, each line's part refers to the symbol of the next line's part."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey")).withColumn("next", F.lead("l_partkey").over(by)).select(F.col("l_partkey").alias("p_partkey"), "next").filter("next IS NOT NULL").distinct()
    target = symbols.select(F.col("p_partkey").alias("next"), "name")
    return steps.join(symbols.select("p_partkey", "path", "is_header"), "p_partkey").join(target, "next").select("path", "is_header", "name")


def _facts(symbols: DataFrame) -> DataFrame:
    """(name, n, file, static) over implementation files: what headers hold is no definition."""
    return symbols.filter("NOT is_header").groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("file"), F.bool_and("is_static").alias("static"))


def resolve_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, name, def, verdict) for distinct (source file, symbol) pairs; names that no implementation file defines are ignored outside headers.

    header: the source is a header, whatever the name. self: the source defines the symbol. static: all
    its definitions are static and elsewhere. edge: the symbol has one defining file. ambiguous: several
    files define it; none is picked. Only implementation files define.
    """
    own = symbols.filter("NOT is_header").select("name", F.col("path").alias("src")).distinct().withColumn("own", F.lit(True))
    pairs = refs.select(F.col("path").alias("src"), "is_header", "name").distinct().join(_facts(symbols), "name", "left").filter("is_header OR n IS NOT NULL").join(own, ["name", "src"], "left")
    mine = F.col("own").isNotNull()
    verdict = F.when(F.col("is_header"), "header").when(mine, "self").when(F.col("static"), "static").when(F.col("n") == 1, "edge").otherwise("ambiguous")
    target = F.when(verdict == "edge", F.col("file")).when(verdict == "self", F.col("src"))
    return pairs.select("src", "name", target.alias("def"), verdict.alias("verdict"))


def file_edges(resolved: DataFrame) -> DataFrame:
    """(src, def, count, syms): distinct symbols between each pair of files."""
    return resolved.filter("verdict = 'edge'").groupBy("src", "def").agg(F.count_distinct("name").alias("count"), F.array_sort(F.collect_set("name")).alias("syms"))


def omitted(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: what the map leaves out: names with several implementations, referred to or not, and the references that were ambiguous, static or from headers."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    left_out = resolved.agg(of("ambiguous").alias("same_name_refs"), of("static").alias("static_refs"), of("header").alias("header_refs"))
    return _facts(symbols).agg(F.count_if(F.col("n") > 1).alias("same_name_symbols")).crossJoin(left_out)  # one row each


def least_distinct(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, least): the k least different values of each group, in order; groups without any are absent.

    Equal values meet once by (group, value); then the rank is limited to k in every task before
    the rows move to their group, so a group of any size brings k rows of each task and no longer array.
    """
    by = Window.partitionBy(*keys).orderBy(value)
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= k)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("least"))


def _fold(edges: DataFrame, src: Column, dst: Column, *more: str) -> DataFrame:
    """Edges between groups with the first SAMPLE symbols by name; capped where there are more: one over is looked for, so that it shows."""
    keys = [*more, "from", "to"]
    folded = edges.withColumn("from", src).withColumn("to", dst).filter("from <> to")
    counts = folded.groupBy(*keys).agg(F.sum("count").alias("count"))
    names = least_distinct(folded.select(*keys, F.explode(F.slice("syms", 1, SAMPLE + 1)).alias("name")), keys, "name", SAMPLE + 1)
    shown = counts.join(names, keys, "left").withColumn("least", F.coalesce("least", F.array().cast("array<string>")))
    return shown.select(*keys, "count", F.slice("least", 1, SAMPLE).alias("syms"), (F.size("least") > SAMPLE).alias("capped"))


def overview(edges: DataFrame, depth: int) -> DataFrame:
    """Edges between folders of a depth."""
    return _fold(edges, group_prefix("src", depth), group_prefix("def", depth))


def file_weights(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("path"), "count").unionByName(edges.select(F.col("def").alias("path"), "count"))
    return both.groupBy("path").agg(F.sum("count").alias("weight"))


def adaptive_groups(edges: DataFrame, share: float = 0.15, most: int = 40) -> list[str]:
    """Folders and files to show: from depth 1, the heaviest child of the heaviest group is split out while that group exceeds `share`.

    All prefixes' weights are one aggregate; the loop of at most `most` steps asks it for one group's children at a time.
    """
    weights = file_weights(edges).select(F.explode(path_prefixes("path")).alias("prefix"), "weight").groupBy("prefix").agg(F.sum("weight").alias("weight")).cache()
    children = lambda parent: [(r.prefix, r.weight) for r in weights.filter((F.col("prefix").startswith(parent + "/") if parent else F.lit(True)) & (F.size(F.split("prefix", "/")) == (parent.count("/") + 2 if parent else 1))).orderBy(F.desc("weight"), "prefix").limit(most).collect()]
    groups = dict(children(""))
    total = (weights.filter(~F.col("prefix").contains("/")).agg(F.sum("weight")).first()[0]) or 0
    whole: set[str] = set()
    while len(groups) < most:
        open_ = [(w, g) for g, w in groups.items() if g not in whole and w > share * total]
        if not open_:
            break
        heaviest = min(open_, key=lambda x: (-x[0], x[1]))[1]
        inside = [(p, w) for p, w in children(heaviest) if p not in groups]
        if not inside:
            whole.add(heaviest)
            continue
        groups[inside[0][0]] = inside[0][1]
        groups[heaviest] -= inside[0][1]
    weights.unpersist()
    return sorted(groups)


def overview_auto(edges: DataFrame, groups: list[str]) -> DataFrame:
    """Edges between the longest groups that hold each end; a file under no group stands for its top folder."""
    table = edges.sparkSession.createDataFrame([(g, g.count("/") + 1) for g in groups], "group string, depth int")
    files = edges.select(F.col("src").alias("path")).union(edges.select("def")).distinct()
    place = files.select("path", F.explode(path_prefixes("path")).alias("group")).join(F.broadcast(table), "group").groupBy("path").agg(F.max_by("group", "depth").alias("group"))
    a, b = place.select(F.col("path").alias("src"), F.col("group").alias("gs")), place.select(F.col("path").alias("def"), F.col("group").alias("gd"))
    joined = edges.join(a, "src", "left").join(b, "def", "left")
    return _fold(joined, F.coalesce("gs", group_prefix("src", 1)), F.coalesce("gd", group_prefix("def", 1)))


def _inside(path: str, module: str) -> Column:
    return F.col(path).startswith(module + "/") | (F.col(path) == module)


def focus(edges: DataFrame, module: str) -> DataFrame:
    """(face, from, to, count, syms, capped): internal edges one level deeper, incoming and outgoing ones by folders of the module's depth."""
    depth = module.count("/") + 1
    src, dst = _inside("src", module), _inside("def", module)
    face = F.when(src & dst, "internal").when(dst, "incoming").when(src, "outgoing")
    part = lambda inside, path: F.when(inside, group_prefix(path, depth + 1)).otherwise(group_prefix(path, depth))
    return _fold(edges.withColumn("face", face).filter("face IS NOT NULL"), part(src, "src"), part(dst, "def"), "face")


def edge_symbols(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All distinct symbols of one displayed edge."""
    return edges.filter(_inside("src", src) & _inside("def", dst)).select(F.explode("syms").alias("name")).distinct()


def children(edges: DataFrame, files: DataFrame, parent: str) -> DataFrame:
    """(path, n_files, is_file, incoming) of the direct children of a folder; incoming counts references from outside the child."""
    depth = parent.count("/") + 2 if parent else 1
    under = lambda c: F.col(c).startswith(parent + "/") if parent else F.lit(True)
    held = files.filter(under("path")).select("path", group_prefix("path", depth).alias("child")).groupBy("child").agg(F.count_distinct("path").alias("n_files"), F.bool_or(F.col("child") == F.col("path")).alias("is_file"))
    inward = edges.filter(under("def")).withColumn("child", group_prefix("def", depth)).filter(~(F.col("src").startswith(F.concat("child", F.lit("/"))) | (F.col("src") == F.col("child"))))
    inward = inward.groupBy("child").agg(F.sum("count").alias("incoming"))
    return held.join(inward, "child", "full").select(F.col("child").alias("path"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("is_file", F.lit(False)).alias("is_file"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("count"), "from", "to").limit(k)


def brief(edges: DataFrame, top: int = 40) -> DataFrame:
    """(line, total_edges, total_count): the top edges as from>to:count."""
    totals = edges.agg(F.count("*").alias("total_edges"), F.sum("count").alias("total_count"))
    return top_edges(edges, top).select(F.concat("from", F.lit(">"), "to", F.lit(":"), F.col("count").cast("string")).alias("line")).crossJoin(F.broadcast(totals))  # totals is one row


def public_surface(edges: DataFrame, files: DataFrame, depth: int = 1) -> DataFrame:
    """(module, files_open, files): files of each folder that others refer to."""
    module = group_prefix("def", depth)
    opened = edges.filter(group_prefix("src", depth) != module).groupBy(module.alias("module")).agg(F.count_distinct("def").alias("files_open"))
    every = files.groupBy(group_prefix("path", depth).alias("module")).agg(F.count_distinct("path").alias("files"))
    return every.join(opened, "module", "left").select("module", F.coalesce("files_open", F.lit(0)).alias("files_open"), "files")
