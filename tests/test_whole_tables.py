"""The _all queries against brute force: every forward edge, word and call takes part."""

import collections

import numpy as np
import pytest

from siltstone.plans import registry

registry.load()
Q = registry.QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(11)
    items = [(o, k, int(p), 1) for o in range(90) for k, p in enumerate(rng.choice(600, 4, False) + 1)] + [(500, 0, 20, 1), (500, 1, 40, 1), (501, 0, 100, 1), (501, 1, 300, 1), (502, 0, 150, 1), (502, 1, 500, 1)]
    items += [(1000 + i, k, 700 + i + k, 1) for i in range(70) for k in (0, 1)]  # a chain of 71 nodes
    parts = [(i, f"{'ab'[i % 2]} x", f"B{i % 3}", f"T{i % 4}", i % 11) for i in range(1, 61)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    orders = collections.defaultdict(list)
    for o, _, p, _ in items:
        orders[o].append(p)
    return folder, orders, parts


def test_graph_queries_use_all_forward_edges(spark, tables):
    folder, orders, _ = tables
    edges = {(a, b) for ps in orders.values() for a, b in zip(ps, ps[1:], strict=False) if a < b}
    nodes = sorted({x for e in edges for x in e})
    above = {n: [a for a, b in edges if b == n] for n in nodes}
    level, depth, reach = {}, {}, {n: set() for n in nodes}
    for n in nodes:  # in order of id, so parents come first
        level[n] = max((level[a] + 1 for a in above[n]), default=0)
        depth[n] = min((depth[a] + 1 for a in above[n]), default=0)
    for n in reversed(nodes):
        for a, b in edges:
            if a == n:
                reach[n] |= {b} | reach[b]
    rows = lambda name: sorted(tuple(r) for r in Q[name](spark, folder).collect())
    assert max(level.values()) >= 70 and rows("topo_levels_all") == sorted(level.items())
    assert rows("depths_all") == sorted(depth.items())
    inside = {20} | reach[20]
    assert rows("subtree_all") == sorted(e for e in edges if set(e) <= inside)
    assert rows("roots_all") == sorted((n,) for n in nodes if not above[n])
    assert rows("delete_nodes_all") == sorted((a, b) for a, b in edges if a % 5 and b % 5)
    assert rows("siblings_all") == sorted((a, b, sum(x == a and y <= b for x, y in edges)) for a, b in edges)
    assert rows("reparent_all") == sorted({(b - 1 if b % 9 == 4 else a, b) for a, b in edges})
    pairs = {(a, b) for ps in orders.values() for a, b in zip(ps, ps[2:], strict=False)}
    got = rows("is_descendant_all")
    assert got == sorted((a, b, b in reach.get(a, ())) for a, b in pairs) and {x[2] for x in got} == {True, False}
    seen, front = {500: 0}, {500}
    for d in range(1, 7):
        front = {a for n in front for a in above[n]} - set(seen)
        seen |= dict.fromkeys(front, d)
    assert 150 in seen and rows("upstream_all") == sorted(seen.items())
    tree = Q["callers_tree_all"](spark, folder).collect()
    assert (300, 100, 1) in {(r.parent, r.node, r.depth) for r in tree} and {r.node for r in tree if r.depth == 1} == set(above[300])


def test_resolve_queries_use_all_words(spark, tables):
    folder, _, parts = tables
    defs = [(f"{n[0]}{s % 7}", ("func", "define", "struct")[s % 3], f"{b}/{t}/{i}" + (".c", ".h", ".cpp", ".txt")[s % 4], s % 5 < 3) for i, n, b, t, s in parts]
    rows = lambda name: sorted(tuple(r) for r in Q[name](spark, folder).collect())
    assert rows("definitions_all") == sorted(d[:3] for d in defs)
    level = lambda p, q, real: 2 if not real or p.split("/")[0] != q.split("/")[0] else 1 if p.split("/")[1] != q.split("/")[1] else 0
    want = []
    for name, _, at, _ in defs:
        found = [(level(at, path, real), path) for n, _, path, real in defs if n == name]
        want += [(name, at, path, k) for k, path in found if k == min(found)[0]]
    assert rows("nearest_level_all") == sorted(want)
    ranked = Q["rank_definition_all"](spark, folder).collect()
    assert {(r.caller_path, r.callee) for r in ranked} == {(d[2], c) for d in defs for c in (d[0], "unknown")}
    assert all(r.candidates == sum(d[0] == r.callee for d in defs) and (r.callee != "unknown" or (r.confidence, r.likely_macro) == ("low", True)) for r in ranked)


def test_adaptive_overview_matches_brute_force(spark):
    """The heaviest group is opened while it is too heavy, and the fold loses no reference."""
    from siltstone.operators import refmap

    rng = np.random.default_rng(8)
    paths = [f"{'abc'[int(x)]}/{'pq'[int(y)]}/{'xyz'[int(z)]}.c" for x, y, z in zip(rng.choice(3, 60, p=[0.7, 0.2, 0.1]), rng.integers(0, 2, 60), rng.integers(0, 3, 60), strict=True)]
    rows = collections.Counter((a, b) for a, b in zip(paths, paths[1:], strict=False) if a != b)
    edges = spark.createDataFrame([(a, b, n, ["s"]) for (a, b), n in rows.items()], "src string, def string, count long, syms array<string>")
    weight = collections.Counter()
    for (a, b), n in rows.items():
        for p in (a, b):
            parts = p.split("/")
            for i in range(len(parts)):
                weight["/".join(parts[: i + 1])] += n
    children = lambda g: sorted((p for p in weight if p.rpartition("/")[0] == g), key=lambda p: (-weight[p], p))
    groups, whole, total = {p: weight[p] for p in children("")}, set(), sum(weight[p] for p in children(""))
    while True:
        heavy = [g for g in groups if g not in whole and groups[g] > 0.15 * total]
        if not heavy or len(groups) >= 40:
            break
        top = min(heavy, key=lambda g: (-groups[g], g))
        inside = [p for p in children(top) if p not in groups]
        if not inside:
            whole.add(top)
            continue
        groups[inside[0]] = weight[inside[0]]
        groups[top] -= weight[inside[0]]
    found = refmap.adaptive_groups(edges)
    assert found == sorted(groups)
    place = lambda p: max((g for g in groups if p == g or p.startswith(g + "/")), key=len)
    folded = collections.Counter()
    for (a, b), n in rows.items():
        folded[place(a), place(b)] += n
    got = {(r["from"], r["to"]): r["count"] for r in refmap.overview_auto(edges, found).collect()}
    assert got == {k: n for k, n in folded.items() if k[0] != k[1]}


def test_nearest_definition_looks_in_the_closure_first(spark):
    from siltstone.operators import resolve

    words = spark.createDataFrame([("f", "a/b/x.c")], "name string, current string")
    symbols = spark.createDataFrame([("f", "a/b/y.c", True), ("f", "z/h.h", True), ("f", "z/d.h", False)], "name string, path string, is_def boolean")
    closure = spark.createDataFrame([("a/b/x.c", "z/h.h"), ("a/b/x.c", "z/d.h")], "current string, path string")
    assert [r.path for r in resolve.nearest_definition(words, symbols).collect()] == ["a/b/y.c"]
    assert [(r.path, r.level) for r in resolve.nearest_definition(words, symbols, closure).collect()] == [("z/h.h", -1)]
