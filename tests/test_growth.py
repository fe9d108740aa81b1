"""What keeps jobs in bounds on large tables: no lines through the driver, work that follows the input."""

import contextlib
import io
import os
import re
import time

import pytest

from siltstone.operators import reach, resolve, search
from siltstone.operators import structure as T
from siltstone.operators import walks
from siltstone.operators.resolve import enclosing_function
from siltstone.plans import registry

registry.load()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LINE_JOBS = ["call_edges", "callees", "callers", "case_blocks", "classify_hits", "code_hits", "code_transitions", "dead_blocks", "decl_pattern_filter", "definition_rules", "extract_definitions", "function_body", "function_spans", "helper_transitions", "ifdef_stack", "leading_comments", "outline", "overcounted_branches", "parameter_places", "static_names", "symbol_cards", "typedef_targets"]


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", LINE_JOBS)
def test_lines_are_not_broadcast(spark, name):
    """A few bytes of parts grow to whole files, which Spark takes for as small as the parts."""
    assert "Broadcast" not in plan_of(registry.QUERIES[name](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name, most", [("call_edges", 5), ("decl_pattern_filter", 4), ("function_body", 5), ("leading_comments", 3)])
def test_lines_are_read_a_few_times(spark, name, most):
    """Begins and ends of spans, and the parts of comments, come from one reading of the lines each."""
    assert plan_of(registry.QUERIES[name](spark, DATA)).count("Generate posexplode(arrays_zip(split(") <= most


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_callers_leave_files_without_the_word_early(spark, monkeypatch):
    """The word is looked for in whole files, before lines are made of them."""
    seen = []
    whole = T.code_lines
    monkeypatch.setattr(T, "code_lines", lambda files: seen.append(files.count()) or whole(files))
    registry.QUERIES["callers"](spark, DATA)
    assert seen == [13]  # of 200: those of parts 7, 8 and 79 to 89
    files = spark.createDataFrame([("a", "f(x)"), ("b", "g /* f( */"), ("c", "f/**/o(1)"), ("d", "h()"), ("e", None)], "path string, content string")
    assert sorted(r.path for r in T.files_with(files, "f(").collect()) == ["a", "b"]
    assert [r.path for r in T.files_with(files, "fo(").collect()] == ["c"]


def test_a_comment_that_ends_behind_slashes_is_told_once(spark):
    lines = T.code_lines(spark.createDataFrame([("a", "/* b\n// c */\nint f() {\n}\n// g\n\nint h() {\n}")], "path string, content string"))
    assert [r.body for r in T.function_body(T.function_spans(lines), lines).orderBy("start_line").collect()] == ["/* b\n// c */\nint f() {\n}", "// g\nint h() {\n}"]


def test_macros_settle_round_by_round(spark):
    rows = [("A", "B + 1"), ("B", "C * 2"), ("C", "3"), ("LOOP", "LOOP + 1"), ("TWO", "1"), ("TWO", "2"), ("D1", "D2"), ("D2", "D3"), ("D3", "D4"), ("D4", "D5"), ("D5", "D6"), ("D6", "D7"), ("D7", "7")]
    macros = spark.createDataFrame([(n, None, b) for n, b in rows] + [("CALL", "(x)", "x")], "name string, params string, body string")
    got = {r.name: r.value for r in T.macro_values(macros).collect()}
    assert got == {"A": 7, "B": 6, "C": 3, "LOOP": None, "TWO": None, "D1": 7, "D2": 7, "D3": 7, "D4": 7, "D5": 7, "D6": 7, "D7": 7, "CALL": None}
    assert plan_of(T.macro_values(macros)).count("Join") == 1  # not one for each way back through the rounds


def test_hits_keep_their_copies_and_columns(spark):
    hits = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("a", 9, "y"), ("b", 1, "z"), (None, 1, "n")], "path string, line_no long, text string")
    spans = spark.createDataFrame([("a", "outer", 1, 8), ("a", "inner", 2, 3)], "path string, name string, start_line int, end_line int")
    got = sorted((tuple(r) for r in enclosing_function(hits, spans).collect()), key=str)
    assert got == sorted([("a", 2, "x", "inner", 2), ("a", 2, "x", "inner", 2), ("a", 9, "y", None, None), ("b", 1, "z", None, None), (None, 1, "n", None, None)], key=str)


def test_branches_nested_and_left_open(spark):
    text = "#if 0\n#ifdef A\nx {\n#endif\ny\n#else\nz\n#endif\n#if 1\nkept\n#elif B\ngone\n#else\ngone\n#endif\n#ifdef C\nf() {\n#elif D\ng() {\n#else\n#endif\nend }\n#if 0\nlast"
    lines = T.code_lines(spark.createDataFrame([("a", text)], "path string, content string"))
    dead = [r.line_no for r in T.dead_blocks(lines).filter("code = '' AND text <> ''").orderBy("line_no").collect()]
    assert dead == [2, 3, 4, 5, 12, 14, 24]
    assert [r.line_no for r in T.overcounted_branches(lines).orderBy("line_no").collect()] == [19]


def _pairs_bounded(spark, job, most):
    """Rows that the job's joins put out, summed over its plan."""
    df = job()
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    stack, rows = [text], 0
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            stack.append(node.plan())
            continue
        if "Join" in name:
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert rows <= most, rows


def test_definitions_of_one_name_do_not_meet_every_call(spark):
    """A name that 600 files define and call: 360,000 pairs, of which no answer needs more than a few for each file."""
    files = [(f"top{i % 3}/d{i // 2}/f{i}.c", i) for i in range(600)]
    d = spark.createDataFrame([("init", ("func", "define", "struct")[i % 3], path, True) for path, i in files], "name string, kind string, path string, is_def boolean")
    calls = d.select(d.path.alias("caller_path"), d.name.alias("callee"))
    _pairs_bounded(spark, lambda: resolve.rank_callee_definition(calls, d.select("name", "kind", "path")), 12_000)
    _pairs_bounded(spark, lambda: resolve.nearest_definition(d.select("name", d.path.alias("current")), d.select("name", "path", "is_def")), 12_000)


def test_best_definitions_against_all_pairs(spark):
    """Deep and shallow folders, files at the top, equal rows, unknown names, files without a name."""
    import random

    draw = random.Random(3)
    folder = lambda: "/".join(draw.choice("ab") for _ in range(draw.choice([0, 1, 2, 3, 12, 13])))
    place = lambda i: f"{folder()}/f{i}{draw.choice(['.c', '.h', '.txt'])}".lstrip("/")
    symbols = [(draw.choice("xyz"), draw.choice(["func", "define", "struct", "member"]), place(i), draw.random() < 0.6) for i in range(60)]
    symbols += [symbols[0], ("w", "define", "a/only.h", False)]
    calls = sorted({(place(i), draw.choice("xyzwu")) for i in range(80)})
    s = spark.createDataFrame(symbols, "name string, kind string, path string, is_def boolean")
    c = spark.createDataFrame(calls, "caller_path string, callee string")
    split = lambda path: path.rsplit("/", 1)[0].split("/") if "/" in path else [""]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    def score(kind, path, caller):
        a, b = split(caller), split(path)
        near = 1000 if a == b else 100 * common(a, b)
        return {"func": 100, "define": 50}.get(kind, 0) + {"c": 10, "h": 5}.get(path.rsplit(".", 1)[1], 0) + near

    got = {(r.caller_path, r.callee): (r.path, r.score, r.candidates, r.confidence, r.likely_macro, r.likely_non_callable) for r in resolve.rank_callee_definition(c, s.select("name", "kind", "path")).collect()}
    for caller, callee in calls:
        own = [(kind, path) for name, kind, path, _ in symbols if name == callee]
        ranked = sorted((-score(kind, path, caller), path) for kind, path in own)
        n = len(ranked)
        best = -ranked[0][0] if ranked else None
        sure = n == 1 or n > 1 and (best >= 1000 or best + ranked[1][0] >= 100)
        confidence = "low" if not n else "high" if sure else "medium" if best >= 100 else "low"
        assert got[caller, callee] == (ranked[0][1] if ranked else None, best, n, confidence, all(k == "define" for k, _ in own), n > 0 and all(k in ("struct", "member") for k, _ in own)), (caller, callee)
    closure = [(caller, path) for caller, _ in calls[:30] for _, _, path, _ in symbols[:9]]
    words = spark.createDataFrame([(n, p) for p, n in calls], "name string, current string")
    for given in (None, closure):
        have = sorted((r.name, r.current, r.path, r.level) for r in resolve.nearest_definition(words, s.select("name", "path", "is_def"), given and spark.createDataFrame(given, "current string, path string")).collect())
        want = []
        for current, callee in calls:
            a = split(current)
            levels = [(-1 if given and (current, path) in given and is_def else len(a) - common(a, split(path)) if is_def else len(a), path) for name, _, path, is_def in symbols if name == callee]
            want += [(callee, current, path, level) for level, path in levels if level == min(levels)[0]]
        assert have == sorted(want)


def test_closures_of_small_parts_equal_the_rounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("x", "y"), ("p", "q"), (None, "q"), ("p", "r"), ("r", "q"), ("q", "s")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("x",), ("p",), ("d",), ("none",), (None,), ("a",)], "start string")
    rows = lambda small: sorted(tuple(r) for r in walks.closures(edges, starts, small).collect())
    want = [("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("p", "q", 1), ("p", "r", 1), ("p", "s", 2), ("x", "x", 1), ("x", "y", 1)]
    assert rows(None) == want and rows(0) == want and rows(3) == want


def test_small_parts_are_closed_without_rounds(spark, tmp_path):
    """A chain of 300 files took 300 rounds over all that was found."""
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    began = spark.sparkContext.statusTracker().getJobIdsForGroup()
    found = walks.closures(chain, spark.createDataFrame([(0,)], "start long"))
    assert found.count() == 300
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(began) < 250


def test_reachability_broadcasts_no_nodes(spark):
    """Tables of ids shrink so far in Parquet that Spark took millions of rows for small."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 4), (4, 1), (5, 6), (1, 1), (None, 1)], "ancestor long, node long")
    df = reach.reachable(edges, pairs)
    assert "Broadcast" not in plan_of(df)
    assert {(r.ancestor, r.node): r.descendant for r in df.collect()} == {(1, 4): True, (4, 1): False, (5, 6): True, (1, 1): True, (None, 1): False}


def test_multiline_search_reads_a_long_tail_once(spark):
    """Half a million characters behind the only match took half a million reads of them."""
    files = spark.createDataFrame([("a", "one.\n" + "x" * 500_000), ("b", "p.\n\nq.\nr"), ("c", "none")], "path string, content string")
    began = time.time()
    found = sorted((r.path, r.line_no, r.match) for r in search.search_multiline(files, r"\.\n").collect())
    assert found == [("a", 1, ".\n"), ("b", 1, ".\n"), ("b", 3, ".\n")]
    assert time.time() - began < 20


def test_multiline_search_goes_on_behind_empty_matches(spark):
    files = spark.createDataFrame([("a", "ab\nb")], "path string, content string")
    assert [r.match for r in search.search_multiline(files, "b*").collect()].count("b") == 2


def test_pairs_share_what_their_ends_lead_to(spark, monkeypatch):
    """A hundred pairs of ten starts and ten goals: levels are rows of an end, not of a pair."""
    edges = [(s, m) for s in range(10) for m in range(100, 130)] + [(m, g) for m in range(200, 230) for g in range(1000, 1010)] + [(m, m + 100) for m in range(100, 130)]
    asked = [(s, g) for s in range(10) for g in range(1000, 1010)]
    rows, real = [], walks.written

    def counted(df, label):
        out = real(df, label)
        if label in ("front", "step", "moved"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(walks, "written", counted)
    got = walks.call_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(asked, "start long, goal long"), 3, None, None, None).collect()
    assert {(r.start, r.goal): r.path for r in got} == {(s, g): [s, 100, 200, g] for s, g in asked}
    assert sum(rows) < 1000  # a pair's own fronts and steps were 27,300 rows


def test_few_bytes_of_costly_rows_are_many_tasks(spark, tmp_path):
    """One small file of parts is one task to Spark; each row's work is the job."""
    spark.range(40_000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert registry.QUERIES["scalar_functions"](spark, str(tmp_path)).rdd.getNumPartitions() >= 5


def test_few_names_meet_tokens_before_the_shuffle(spark):
    lines = spark.createDataFrame([("a", "work of a worker, work"), ("b", "no wörk"), (None, "work")], "path string, text string")
    found = search.tokens_in_file(lines, spark.createDataFrame([("work",), ("work",), ("a",)], "name string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "work"), ("a", "a"), (None, "work")], key=str)
    assert "SortMergeJoin" not in plan_of(found)  # every token of every text was sorted by name


def test_subtrees_meet_by_folder_only(spark):
    """Every pair of one name whose folders lie in one line, as the plain comparison gives them, and no join on the name alone."""
    rows = [(n, f, i) for i, (n, f) in enumerate((n, f) for n in "xy" for f in ("a", "a/b", "a/b/c", "ab", "a/bc", "d", "d", "d/e/f/g"))]
    left = spark.createDataFrame(rows, "name string, folder string, i int")
    right = left.withColumnRenamed("i", "j")
    found = resolve.subtree_pairs(left, right)
    want = left.join(right.withColumnRenamed("folder", "other"), "name").filter(resolve.in_subtree("folder", "other"))
    assert sorted((r.name, r.i, r.j) for r in found.collect()) == sorted((r.name, r.i, r.j) for r in want.collect())
    keys = re.findall(r"SortMergeJoin\(?\S* ?\[([^\]]*)\]", plan_of(found))
    assert keys and all("folder#" in k for k in keys), keys


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_siblings_are_made_in_many_tasks(spark):
    assert registry.QUERIES["sibling_sources"](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
