"""Graph jobs as iterative joins. Edges are (src, dst); every loop has a depth that the caller names or ends when nothing is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.reach import levels, reachable
from siltstone.operators.walks import apply_moves
from siltstone.sources.scratch import cut, fresh_folder, written


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): nodes reachable from seeds(node), each at its least depth; within max_depth steps if given. Rounds are partitions of one folder."""
    spark, folder = edges.sparkSession, fresh_folder(edges.sparkSession, "closure")
    edges = written(edges.select("src", "dst").distinct(), "edges")
    front, depth = seeds.select("node").distinct().withColumn("depth", F.lit(0)), 0
    schema = front.schema
    while True:
        front.write.parquet(f"{folder}/round={depth}")
        front, seen = (spark.read.schema(schema).parquet(f"{folder}{at}") for at in (f"/round={depth}", ""))
        if front.isEmpty() or depth == max_depth:
            return seen.select("node", "depth")
        depth += 1
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))


def callers_tree(edges: DataFrame, word: str, max_depth: int = 5, registration: DataFrame | None = None) -> DataFrame:
    """(parent, node, depth, stop): edges of the tree above a node with why a branch ends.

    stop: already_visited where the node stands at a lesser depth or earlier in order, registration_site
    where registration(node) lists it, depth_limit at the last depth where more would follow, else null.
    """
    backward = edges.select(F.col("dst").alias("parent"), F.col("src").alias("node")).distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(word,)], "node string").withColumn("node", F.col("node").cast(edges.schema["src"].dataType))
    front, out = seen, None
    for depth in range(1, max_depth + 1):
        step = front.withColumnRenamed("node", "parent").join(backward, "parent").join(seen.withColumn("_old", F.lit(True)), "node", "left")
        first = F.row_number().over(Window.partitionBy("node").orderBy("parent")) > 1
        step = cut(step.withColumn("stop", F.when(F.col("_old") | first, "already_visited")).select("parent", "node", F.lit(depth).alias("depth"), "stop"))
        if registration is not None:
            step = step.join(registration.select("node").distinct().withColumn("_r", F.lit(True)), "node", "left").withColumn("stop", F.coalesce("stop", F.when(F.col("_r"), "registration_site"))).select("parent", "node", "depth", "stop")
        out = step if out is None else out.unionByName(step)
        front = cut(step.filter("stop IS NULL").select("node").distinct())
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    more = backward.select(F.col("parent").alias("node")).distinct().withColumn("_more", F.lit(True))
    last = (F.col("depth") == max_depth) & F.col("stop").isNull() & F.col("_more")
    return out.join(more, "node", "left").select("parent", "node", "depth", F.when(last, "depth_limit").otherwise(F.col("stop")).alias("stop"))


def callees_tree(edges: DataFrame, word: str, max_depth: int = 5, facts: DataFrame | None = None) -> DataFrame:
    """callers_tree downwards. facts(node, candidates, likely_macro, likely_non_callable): macros and what can't be called are no branches (excluded_callees counts them), and a branch ends as no_definition where nothing defines the node."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if facts is None:
        return callers_tree(turned, word, max_depth)
    out = facts.filter("candidates > 0 AND (likely_macro OR likely_non_callable)").select(F.col("node").alias("src"))
    ends = facts.filter("candidates = 0").select("node")
    tree = callers_tree(turned.join(out, "src", "left_anti").select("src", "dst"), word, max_depth, ends)
    return tree.withColumn("stop", F.when(F.col("stop") == "registration_site", "no_definition").otherwise(F.col("stop")))


def excluded_callees(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, macros, non_callables): how many callees of each node a tree leaves out."""
    kinds = facts.filter("candidates > 0 AND (likely_macro OR likely_non_callable)").select(F.col("node").alias("dst"), "likely_macro")
    joined = edges.select("src", "dst").distinct().join(kinds, "dst")
    return joined.groupBy(F.col("src").alias("node")).agg(F.count_if("likely_macro").alias("macros"), F.count_if(~F.col("likely_macro")).alias("non_callables"))


def call_path(edges: DataFrame, start: str, goal: str, max_depth: int = 6) -> DataFrame:
    """One row (found, hops, path, visited): a shortest chain by a search from both ends that extends the smaller front; ties by least node."""
    kind = edges.schema["src"].dataType
    spark = edges.sparkSession
    edges = edges.select("src", "dst").distinct()
    point = lambda x: spark.createDataFrame([(str(x),)], "node string").select(F.col("node").cast(kind).alias("node"), F.lit(None).cast(kind).alias("via"), F.lit(0).alias("depth"))
    sides = [cut(point(start)), cut(point(goal))]
    fronts, depths, meet = list(sides), [0, 0], None
    while True:
        both = sides[0].select("node", F.col("depth").alias("a")).join(sides[1].select("node", F.col("depth").alias("b")), "node").orderBy(F.col("a") + F.col("b"), "node").first()
        if both or sum(depths) >= max_depth:
            meet = both
            break
        sizes = [f.count() for f in fronts]
        if 0 in sizes:
            break
        k = 0 if sizes[0] <= sizes[1] else 1
        near, far = ("src", "dst") if k == 0 else ("dst", "src")
        step = fronts[k].select(F.col("node").alias(near)).join(edges, near).groupBy(F.col(far).alias("node")).agg(F.min(near).alias("via"))
        depths[k] += 1
        fronts[k] = cut(step.join(sides[k], "node", "left_anti").withColumn("depth", F.lit(depths[k])))
        sides[k] = cut(sides[k].unionByName(fronts[k]))
    visited = sides[0].count() + sides[1].count()
    chain = []
    if meet:
        for k in (0, 1):  # at most max_depth lookups of one row
            node, part = meet["node"], []
            while node is not None:
                part.append(node)
                node = sides[k].filter(F.col("node") == F.lit(node)).first()["via"]
            chain = part[::-1] if k == 0 else chain + part[1:]
    return spark.createDataFrame([(bool(meet), len(chain) - 1 if meet else None, ">".join(map(str, chain)) if meet else None, visited)], "found boolean, hops int, path string, visited long")


def topological_levels(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """(node, level): level 0 without parents, else one above the highest parent; null for nodes on or behind a cycle, which reach.cycle_report tells apart."""
    known = nodes.select(F.col("node").alias("src")).distinct()
    return levels(nodes, edges.join(known.hint("merge"), "src", "left_semi"), small)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters."""
    return nodes.select("node").distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def tree_depths(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): least depth below a root; edges labelled seq make no parent."""
    own = edges.filter(F.coalesce(F.col("label") != "seq", F.lit(True)))
    return closure(own, roots(nodes, own), max_depth)


def parents(edges: DataFrame) -> DataFrame:
    return edges.filter(F.coalesce(F.col("label") != "seq", F.lit(True))).select(F.col("dst").alias("node"), F.col("src").alias("parent")).distinct()


def siblings(edges: DataFrame) -> DataFrame:
    """(parent, node, place): children of a parent in order."""
    own = parents(edges)
    return own.select("parent", "node", F.row_number().over(Window.partitionBy("parent").orderBy("node")).alias("place"))


def is_descendant(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(ancestor, node) with descendant: whether node can be reached from ancestor in one step or more, however many."""
    return reachable(edges, pairs)


def extract_subtree(nodes: DataFrame, edges: DataFrame, node) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(moved nodes, moved edges, nodes left, edges left): crossing edges are dropped."""
    kind = nodes.schema["node"].dataType
    seed = nodes.filter(F.col("node") == F.lit(node).cast(kind)).select("node")
    inside = closure(edges, seed).select("node")
    s, d = inside.withColumnRenamed("node", "src"), inside.withColumnRenamed("node", "dst")
    inner = edges.join(s, "src", "left_semi").join(d, "dst", "left_semi").select(edges.columns)
    outer = edges.join(s, "src", "left_anti").join(d, "dst", "left_anti").select(edges.columns)
    return nodes.join(inside, "node", "left_semi"), inner, nodes.join(inside, "node", "left_anti"), outer


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gone.select("node").distinct()
    left = edges.join(g.withColumnRenamed("node", "src"), "src", "left_anti").join(g.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return nodes.join(g, "node", "left_anti"), left.select(edges.columns)


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Adding is idempotent on (src, dst, label)."""
    return edges.unionByName(more).dropDuplicates(["src", "dst", "label"])


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst", "label").distinct(), ["src", "dst", "label"], "left_anti").select(edges.columns)


def reparent(edges: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, refused(node, parent)): moves(node, parent) replace a node's incoming edges, one after another by seq, or by node and parent where they have none.

    A move that would close a cycle with the edges and moves before it is refused, so a batch makes none.
    """
    if "seq" not in moves.columns:
        moves = moves.select(F.struct("node", "parent").alias("seq"), "node", "parent").distinct()
    moved, verdicts = apply_moves(edges, moves)
    return moved.select(edges.columns), verdicts.filter("NOT accepted").select("node", "parent")


def expand_nodes(parent: str, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): search hits become children; hits(id, path, line_no, text)."""
    label = F.concat("path", F.lit(":"), F.col("line_no").cast("string"))
    return hits.select(F.col("id").alias("node"), label.alias("label"), "path", "line_no", "text"), hits.select(F.lit(parent).alias("src"), F.col("id").alias("dst"), label.alias("label"))


def trail_edges(trail: DataFrame) -> DataFrame:
    """(session, src, dst): distinct steps between different items that follow each other in a session; trail(session, seq, item)."""
    by = Window.partitionBy("session").orderBy("seq")
    return trail.withColumn("src", F.lag("item").over(by)).filter("src <> item").select("session", "src", F.col("item").alias("dst")).distinct()
