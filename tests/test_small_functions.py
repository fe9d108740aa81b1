"""Fuzzy scores, indents, row files, definition rules and capped hits on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.operators import resolve, search
from siltstone.sources import files
from siltstone.streaming import live


def test_common_indent_goes(spark):
    rows = [(["    a", "      b", "", "    c"],), (["a", "  b"],), ([" x"],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "lines array<string>").select(C.strip_common_indent("lines")).collect()]
    assert got == [["a", "  b", "", "c"], ["a", "  b"], ["x"], []]


def test_rows_as_json_lines(spark, tmp_path):
    files.write_ndjson(spark.createDataFrame([(1, "é"), (2, None)], "a int, b string").coalesce(1), f"{tmp_path}/rows")
    (part,) = (tmp_path / "rows").glob("part-*.json")
    assert [json.loads(x) for x in part.read_text(encoding="utf-8").splitlines()] == [{"a": 1, "b": "é"}, {"a": 2}]


def _score(path, query):
    total = 0
    for part in query.lower().split():
        at = run = score = 0
        for c in path.lower():
            if at < len(part) and part[at] == c:
                score, at, run = score + 1 + run, at + 1, run + 1
            else:
                run = 0
        if at < len(part):
            return None
        total += score
    return total


@pytest.mark.parametrize("query", ["ab", "src c", "zz", "A b"])
def test_fuzzy_rank_matches_brute_force(spark, query):
    paths = ["src/ab.c", "src/a/b.c", "abc/x.h", "lib/zab.c", "c/src", "a b", ""]
    got = [(r.path, r.score) for r in search.fuzzy_rank(spark.createDataFrame([(p,) for p in paths], "path string"), query, 4).collect()]
    want = sorted(((p, _score(p, query)) for p in paths if _score(p, query) is not None), key=lambda r: (-r[1], r[0]))[:4]
    assert got == want


def test_annotations_and_wrong_names_define_nothing(spark):
    code = ["int f(void);", "void f(&x->lock)", "real(int a)", "{", "int g(int a) f(b)", "{", "int f(void)", "{", "#define f 1"]
    lines = spark.createDataFrame([("a.c", i + 1, t) for i, t in enumerate(code)], "path string, line_no int, text string")
    hits = spark.createDataFrame([("f", "func", "a.c", n) for n in (1, 2, 5, 7)] + [("f", "define", "a.c", 9), ("f", "func", "gone.c", 3)], "name string, kind string, path string, line_no int")
    got = {(r.path, r.line_no): (r.is_def, r.wrong_name, r.annotation) for r in resolve.judge_definitions(hits, lines).collect()}
    assert got == {("a.c", 1): (False, False, False), ("a.c", 2): (True, False, True), ("a.c", 5): (True, True, False), ("a.c", 7): (True, False, False), ("a.c", 9): (True, False, False), ("gone.c", 3): (True, False, False)}
    kept = {(r.path, r.line_no) for r in resolve.choose_definitions(hits, lines).collect()}
    assert kept == {("a.c", 7), ("a.c", 9), ("gone.c", 3)}


def test_pattern_tables_in_one_and_in_several_automata(spark):
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(["abcd ABC", "", None, "xyzÄ", "bc"])], "path string, line_no int, text string").withColumn("extra", F.lit(1))
    patterns = ["abc", "ABC", "bc", "bc", "cd ", None, "zä", "nothing", ""]
    want = sorted((i, p) for i, t in enumerate(["abcd ABC", "", None, "xyzÄ", "bc"]) if t is not None for p in {p for p in patterns if p is not None} if p.lower() in t.lower())
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    for most in (search.MOST_LETTERS, 5):
        got = search.search_table(lines, table, most)
        assert sorted((r.line_no, r.pattern) for r in got.collect()) == want and got.columns == ["path", "line_no", "text", "pattern"]
    assert search.search_table(lines, table.filter("pattern = 'x'")).count() == 0


def test_many_patterns_match_sql(spark):
    lines = spark.range(300).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("line_no"), F.concat_ws(" ", F.hex(F.col("id") * 7919), F.hex(F.col("id") * 104729)).alias("text"))
    patterns = spark.range(100_000).select(F.concat(F.lit("a"), F.hex(F.col("id"))).alias("pattern"))
    want = {(r.line_no, r.pattern) for r in lines.join(patterns.filter("id < 100000") if "id" in patterns.columns else patterns, F.lower("text").contains(F.lower("pattern"))).collect()}
    assert {(r.line_no, r.pattern) for r in search.search_table(lines, patterns).collect()} == want and want


def test_the_cap_takes_the_first_by_place(spark, tmp_path):
    sink = live.capped_sink(3, f"{tmp_path}/hits")
    sink(spark.createDataFrame([("b", 1), ("a", 9), ("a", 2), ("c", 1), ("a", 5)], "path string, line_no int").repartition(3), 0)
    assert {(r.path, r.line_no) for r in spark.read.parquet(f"{tmp_path}/hits").collect()} == {("a", 2), ("a", 5), ("a", 9)}


def test_prototypes_go_by_each_rows_word(spark):
    rows = [("a", 1, "int f(int x);", None, "f"), ("a", 2, "ops = { f, g(1) };", None, "f"), ("a", 2, "ops = { f, g(1) };", None, "g"), ("a", 3, "  f(1);", "h", "f"), ("a", 4, "xf(1), f = 2;", None, "f"), ("a", 5, "f  (1)", None, "f")]
    sites = spark.createDataFrame(rows, "path string, line_no int, text string, func string, word string")
    assert sorted((r.line_no, r.word) for r in search.decl_pattern_filter(sites, F.col("word")).collect()) == [(2, "f"), (3, "f"), (4, "f")]
    assert sorted((r.line_no, r.word) for r in search.decl_pattern_filter(sites, "g").collect()) == [(1, "f"), (3, "f"), (4, "f"), (5, "f")]
