"""Golden rows on small C sources, with decoys in comments, strings and dead blocks."""

from pyspark.sql import functions as F

from siltstone.functions.evaluate import evaluate
from siltstone.functions.flow import Scan
from siltstone.operators import states
from siltstone.operators import structure as T

SOURCE = r"""/* helper( */
#include "x.h"
#define MAX 4
#define TWICE (MAX * 2)
#define LONG 1 + \
  2
#define CALL(x) x
#define LOOP_A LOOP_B
#define LOOP_B LOOP_A
enum color { RED, GREEN = 5, BLUE, /* note */ ODD = f(), LAST };
static int helper(int a, void (*cb)(int))
{
    // decoy(
    char *s = "other( {";
    cb(a);
    return a ? helper2(a) : 0;
}
#if 0
int dead(void) { return helper(1, 0); }
#else
int alive(void) { return 1; }
#endif
#ifdef FEATURE
int feature(int x) {
#else
int feature(int x, int y) {
#endif
    switch (x) {
    case 1:
    case 2:
        helper(x, 0);
        break;
    default:
        alive();
    }
    return MAX;
}
"""


def _lines(spark, source=SOURCE):
    return T.code_lines(spark.createDataFrame([("a.c", source)], "path string, content string")).cache()


def test_code_view_keeps_lines_and_drops_noise(spark):
    rows = {r.line_no: r.code for r in _lines(spark).collect()}
    assert len(rows) == len(SOURCE.split("\n"))
    assert rows[1].strip() == "" and rows[13].strip() == "" and "other" not in rows[14] and "{" not in rows[14]


def test_function_spans(spark):
    got = {(r.name, r.start_line, r.end_line) for r in T.function_spans(_lines(spark)).collect()}
    assert got == {("helper", 11, 17), ("alive", 21, 21), ("feature", 24, 37)}


def test_call_edges_and_callers(spark):
    lines = _lines(spark)
    edges = T.call_edges(T.dead_blocks(lines), T.function_spans(lines))
    got = {(r.caller, r.callee) for r in edges.collect()}
    assert got == {("helper", "helper2"), ("helper", "cb"), ("feature", "helper"), ("feature", "alive")}
    none = spark.createDataFrame([("a.c", "feature", 35), ("a.c", None, 40)], "path string, func string, line_no int")
    sites = {(r.func, r.line_no, r.indirect) for r in T.callers(edges, none, "helper").collect()}
    assert sites == {("feature", 31, False), (None, 40, True)}


def test_inactive_lines(spark):
    source = "#if A > 1\none\n#elif defined(B)\ntwo\n#ifdef C\nthree\n#endif\n#else\nfour\n#endif\nfive"
    configs = spark.createDataFrame([("none", {}), ("a", {"A": 2, "B": 1}), ("bc", {"B": 1, "C": 1})], "config string, defines map<string,int>")
    rows = T.inactive_lines(_lines(spark, source), configs).collect()
    dead = {c: {r.line_no for r in rows if r.config == c} for c in ("none", "a", "bc")}
    text = {c: {2, 4, 6, 9} & dead[c] for c in dead}
    assert text == {"none": {2, 4, 6}, "a": {4, 6, 9}, "bc": {2, 9}}


def test_ifdef_stack(spark):
    lines = _lines(spark, "#if A\n#ifdef B\nx\n#else\ny\n#endif\n#endif")
    hits = lines.filter("line_no IN (3, 5)").select("path", "line_no")
    got = {r.line_no: [(s.directive, s.condition) for s in r.ifdef_stack] for r in T.ifdef_stack(hits, lines).collect()}
    assert got == {3: [("if", "A"), ("ifdef", "B")], 5: [("if", "A"), ("else", "")]}


def test_macros_and_enums(spark):
    lines = _lines(spark)
    values = {r["name"]: r["value"] for r in T.macro_values(T.define_blocks(lines)).collect()}
    assert values == {"MAX": 4, "TWICE": 8, "LONG": 3, "CALL": None, "LOOP_A": None, "LOOP_B": None}
    members = {r["name"]: r["value"] for r in T.enum_members(lines).collect()}
    assert members == {"RED": 0, "GREEN": 5, "BLUE": 6, "ODD": None, "LAST": None}


def test_conflicting_macros_have_no_value(spark):
    got = T.macro_values(T.define_blocks(_lines(spark, "#define A 1\n#define B A\n#define A 2"))).collect()
    assert {r["name"]: r["value"] for r in got} == {"A": None, "B": None}


def test_case_blocks(spark):
    lines = _lines(spark)
    hits = spark.createDataFrame([("a.c", 31), ("a.c", 33), ("a.c", 3)], "path string, line_no int")
    got = {r.line_no: (r.label, r.start_line, r.end_line) for r in T.case_blocks(lines, hits).collect()}
    assert got[31] == ("case 1, case 2", 29, 32) and got[33][:2] == ("default", 33) and got[3] == ("", 1, 7)


def test_extract_definitions(spark):
    got = {(r["name"], r.kind) for r in T.extract_definitions(_lines(spark)).collect()}
    assert {("MAX", "define"), ("color", "enum"), ("helper", "func"), ("alive", "func")} <= got


def test_extracted_definitions_are_judged_and_hold_enum_members(spark):
    files = [("a.c", "int wide(int a,\n  int b);\nint wide(int a,\n  int b)\n{\n}\nint only(int a);\nenum e { P,\n  Q = 2 };\nstruct s {\n};\nvoid __acquires(&l->m)\nreal(struct s *p)\n{\n}"), ("a.h", "int wide(int a, int b);\nint only(int a);\nstruct s {\n};\nint other(int a) wide(lock)\n{\n}")]
    lines = T.code_lines(spark.createDataFrame(files, "path string, content string"))
    got = sorted((r["name"], r.kind, r.path, r.line_no) for r in T.extract_definitions(lines).collect())
    assert got == sorted([("wide", "func", "a.c", 3), ("only", "func", "a.c", 7), ("e", "enum", "a.c", 8), ("P", "enum_member", "a.c", 8), ("Q", "enum_member", "a.c", 9), ("s", "struct", "a.c", 10), ("__acquires", "func", "a.c", 12), ("other", "func", "a.h", 5)])


def test_function_body(spark):
    lines = _lines(spark)
    body = T.function_body(T.function_spans(lines), lines).filter(F.col("name") == "alive").first()["body"]
    assert body == "int alive(void) { return 1; }"


def test_evaluate():
    cases = {"1 + 2 * 3": 7, "(1 | 6) ^ 2": 5, "-8 / 3": -2, "1 << 4 >> 2": 4, "defined(A) && !defined(B)": 1, "X": 0, "1 ? 2 : 3": 2, "0x10 == 16": 1, "010": 8, "1 / 0": None, "f(1)": None, "": None, "~0": -1, "3U + 1L": 4}
    assert {e: evaluate(e, {"A": 1}) for e in cases} == cases


BODY = "void f(struct s *s) {{ switch (s->st) {{ {} }} }}"
FLOWS = [
    (BODY.format("case A: s->st = B; break; case C: s->st = D; break;"), "A->B C->D"),
    (BODY.format("case A: case B: s->st = C; break;"), "A|B->C"),
    (BODY.format("case A: prep(s); case B: s->st = C; break;"), "A|B->C"),
    (BODY.format("case A: s->st = B; return; case C: s->st = D;"), "A->B C->D"),
    (BODY.format("case A: default: s->st = B; break;"), "?->B"),
    (BODY.format("case A: switch (s->o) { case X: s->st = B; break; } break;"), "A->B"),
    (BODY.format("case P: switch (r) { case X: s->st = M; default: s->st = E; break; } break;"), "P->M M|P->E"),
    (BODY.format("case P: switch (r) { case X: s->st = M; break; default: s->st = E; } break;"), "P->M P->E"),
    (BODY.format("case A: if (flush(s) != 1) return; s->st = B; return; case C: s->st = D;"), "A->B C->D"),
    (BODY.format("case R: if (ok(s)) { s->st = E; if (again(s)) { s->st = R; return; } } else { s->st = D; } return;"), "R->E E->R R->D"),
    (BODY.format("case N: if (bad(s)) return; case K: s->st = C; if (r <= 0) { s->st = K; return; } case W: s->st = V; break;"), "N|K->C C->K C|W->V"),
    (BODY.format("case A: s->st = compute(s); s->st = B; break;"), "A->compute(s) ?->B"),
    ("void f() { if (s->st == A || s->st == B) { s->st = C; } }", "A|B->C"),
    ("void f() { if (s->st == A) s->st = B; s->st = C; }", "A->B ?->C"),
    ("void f() { if (s->st == A) log(s); s->st = B; }", "?->B"),
    ("void f() { if (s->st != A) { s->st = B; } if (!(s->st == C)) { s->st = D; } }", "?->B ?->D"),
    ("void f() { if (s->st == A) s->st = B; else s->st = C; }", "A->B ?->C"),
    ("void f() { if (s->st == A) s->st = B; else if (s->st == C) s->st = D; }", "A->B C->D"),
    ("void f() { int st = I; if (st == I) st = R; }", "?->I I->R"),
    ("void f() { s->other_st = X; st_extra = Y; s->st =\n  LONG_NAME; }", "?->LONG_NAME"),
    ("void f() { if (s->st >= B) use(s); }", ""),
    ("void f() { int st; st = s->st; s->st = B; s->st = st; }", "?->B B->st"),
    ("void f() { while (x) { s->st = A; } s->st = B; do { s->st = C; } while (y); }", "?->A ?->B B->C"),
    ("struct s x = { .st = A }; void f() { s->st = Tcp_Open; }", "?->Tcp_Open"),
    ("} ) if ( { case", ""),
]


def test_flow_of_states():
    for source, want in FLOWS:
        got = [("|".join(c.before.names or ()) or "?") + "->" + c.rhs for c in Scan(source, "st").run()]
        assert got == want.split(), source
    last = Scan(BODY.format("case R: s->st = BUSY;\nif (fail(s)) return; case N:\ns->st = D; break;"), "st").run()[-1]
    assert (last.line, last.fell) == (3, [("BUSY", 1)])
    deep = Scan("void f() { " + "{" * 5000 + "s->st = A;" + "}" * 5000 + " s->st = B; }", "st").run()
    assert [c.rhs for c in deep] == ["B"]


def test_transitions_ignore_directives_and_noise(spark):
    source = "#define SET(s) ((s)->st = MACRO)\n#if defined(st) && st == COND\n#endif\nvoid f(struct s *s) {\n  /* s->st = OLD; */ log(\"s->st = FAKE\");\n  s->st = B;\n}"
    rows = states.code_transitions(spark.createDataFrame([("a.c", source), ("b.c", "int x;")], "path string, content string"), "st").collect()
    assert [(r.path, r.func, r.line_no, r.from_states, r["to"]) for r in rows] == [("a.c", "f", 6, None, "B")]


def test_comments_above(spark):
    source = "/* one */\n// two\n\nint a;\n\n\n// far\n\n\nint b;\n/* long\n   block */\n// and\nint c;\nint d; /* tail */\nint e;\n" + "// x\n" * 51 + "int f;"
    lines = _lines(spark, source)
    got = {r.line_no: r.comment for r in T.leading_comment(lines.filter("code LIKE 'int%'"), lines).collect()}
    assert got == {4: "/* one */\n// two", 14: "/* long\n   block */\n// and"}
