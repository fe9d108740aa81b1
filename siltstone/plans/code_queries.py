"""Jobs over C-like text: a file for every part, made from its key and size.

The SQL doesn't read the text. It states what a reader finds in it, by line, for every part.
"""

from pyspark.sql import functions as F

from siltstone.operators import resolve as R
from siltstone.operators import search as S
from siltstone.operators import states as X
from siltstone.operators import structure as T
from siltstone.operators.joins import merged
from siltstone.plans.registry import query
from siltstone.sources import table
from siltstone.sources.scratch import written

#: K: the part's key, J: the next key, S: its size. A part's file begins with S % 3 empty lines.
SOURCE = """/* helper_<K>( is no call */
#include "part_<J>.h"
#include <sys/common.h>
#define MAX_<K> <S>
#define TWICE_<K> (MAX_<K> * 2)
#define LONG_<K> 1 + \\
  <S>
#define CALL_<K>(x) x
#define ALIAS_<K> TWICE_<K>
static int count_<K> = 0;
enum color_<K> { RED_<K>, GREEN_<K> = <S>, BLUE_<K>,
  ODD_<K> = f(), LAST_<K> };
struct node_<K> {
  int a;
};
typedef struct node_<K> node_t_<K>;

/* helps
 * part <K> */
static int helper_<K>(int a, void (*cb)(int))
{
    char *s = "other_<K>( {"; // decoy_<K>(
    count_<K> = a;
    return other_<K>(a);
}
#if 0
int dead_<K>(void) { return helper_<K>(1, 0); }
#endif
#ifdef FEATURE
int run_<K>(int x) {
#else
int run_<K>(int x, int y) {
#endif
    switch (x) {
    case ONE_<K>:
    case TWO_<K>:
        helper_<K>(x, 0);
        break;
    default:
        run_<J>(x);
    }
    return MAX_<K>;
}
// shown
int late_<K>(void);

  int deep_<K>(void) { return p->count_<K> + count_<K>; }"""

MACHINE = """void set_<K>(struct s *s, int next)
{
    s->st = next;
}
void step_<K>(struct s *s)
{
    int st = s->st; /* s->st = OLD_<K>; */
    switch (s->st) {
    case IDLE_<K>:
        s->st = BUSY_<K>;
        if (bad(s))
            return;
    case WAIT_<K>:
        s->st = DONE_<K>;
        break;
    case DONE_<K>:
        set_<K>(s, IDLE_<K>);
        break;
    default:
        s->st = pick(s);
        if (s->st == PICK_<K>)
            set_<K>(s, WAIT_<K>);
        else
            set_<K>(s, st);
    }
}"""

P = "p AS (SELECT p_partkey AS k, p_partkey + 1 AS j, p_size AS s, p_size % 3 AS d, 'src' || p_partkey % 7 || '/part_' || p_partkey || '.c' AS path FROM part)"


def _fill(text: str) -> str:
    return f"replace(replace(replace({text}, '<K>', CAST(k AS VARCHAR)), '<J>', CAST(j AS VARCHAR)), '<S>', CAST(s AS VARCHAR))"


def _value(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def golden(columns: str, rows: list[tuple], more: str = "") -> str:
    """SQL of what every part's file shows: columns as `name`, `name:line` for line numbers, `name:int` and `name:s` for the size plus a number."""
    names = [c.split(":") for c in columns.split()]
    kinds = {"line": "CAST(v.{0} + d AS INT)", "int": "v.{0}", "s": "CASE WHEN v.{0} IS NOT NULL THEN CAST(s + v.{0} AS BIGINT) END"}
    shown = [kinds[n[1]].format(n[0]) if len(n) > 1 else _fill(f"v.{n[0]}") for n in names]
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    picked = ", ".join(f"{e} AS {n[0]}" for e, n in zip(shown, names, strict=True))
    return f"WITH {P} SELECT path, {picked}{more} FROM p, (VALUES {values}) v({', '.join(n[0] for n in names)})"


#: Files are dealt by path before their texts are made, so many to a task. What is windowed, grouped and joined by path needs no shuffle of lines then.
FILES_A_TASK = 2_000


def _files(spark, sf_dir, source: str = SOURCE):
    part = table(spark, sf_dir, "part")
    shares = max(spark.sparkContext.defaultParallelism, -(-part.count() // FILES_A_TASK))
    path = F.concat(F.lit("src"), (F.col("p_partkey") % 7).cast("string"), F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit(".c"))
    part = part.select("p_partkey", "p_size", path.alias("path")).repartition(shares, "path")
    text = F.lit(source)
    for mark, value in (("<K>", F.col("p_partkey")), ("<J>", F.col("p_partkey") + 1), ("<S>", F.col("p_size"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return part.select("path", F.concat(F.repeat(F.lit("\n"), F.col("p_size") % 3), text).alias("content"))


def _lines(spark, sf_dir):
    return T.code_lines(_files(spark, sf_dir))


def _spans(spark, sf_dir):
    return T.function_spans(_lines(spark, sf_dir))


@query(golden("line_no:line code", [(1, ""), (10, "static int count_<K> = 0;"), (19, ""), (22, "char *s = ;"), (24, "return other_<K>(a);"), (26, "#if 0"), (27, "int dead_<K>(void) { return helper_<K>(1, 0); }"), (47, "int deep_<K>(void) { return p->count_<K> + count_<K>; }")]))
def code_view(spark, sf_dir):
    """Some lines of each file without comments and strings."""
    lines = _files(spark, sf_dir).select("path", (F.length("content") - F.length(F.ltrim("content"))).alias("_"), F.size(F.split("content", "\n")).alias("n"))
    shift = lines.select("path", (F.col("n") - 47).alias("d"))
    wanted = F.col("line_no") - F.col("d")
    code = merged(_lines(spark, sf_dir), shift, "path").filter(wanted.isin(1, 10, 19, 22, 24, 26, 27, 47))
    return code.select("path", "line_no", F.trim("code").alias("code"))


@query(golden("line_no:line", [(27,)]))
def dead_blocks(spark, sf_dir):
    """Lines that hold code only in a block that #if 0 takes out."""
    lines = _lines(spark, sf_dir)
    gone = T.dead_blocks(lines).filter("code = ''").select("path", "line_no")
    return merged(lines.filter("trim(code) <> ''"), gone, ["path", "line_no"], "left_semi").select("path", "line_no")


FUNCTIONS = [("helper_<K>", 20, 25), ("run_<K>", 30, 43), ("deep_<K>", 47, 47)]


@query(golden("name start_line:line end_line:line", FUNCTIONS))
def function_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(golden("line_no:line", [(32,)]))
def overcounted_branches(spark, sf_dir):
    return T.overcounted_branches(_lines(spark, sf_dir))


@query(golden("name detail start_line:line end_line:line", [("helper_<K>", "static int helper_<K>(int a, void (*cb)(int))", 20, 25), ("run_<K>", "int run_<K>(int x) {", 30, 43), ("deep_<K>", "int deep_<K>(void) { return p->count_<K> + count_<K>; }", 47, 47)]))
def outline(spark, sf_dir):
    return T.outline(_lines(spark, sf_dir))


_TEXT = SOURCE.split("\n")


def _body(first: int, last: int) -> str:
    return "\n".join(_TEXT[first - 1 : last])


@query(golden("name body", [("helper_<K>", _body(18, 25)), ("run_<K>", _body(30, 43)), ("deep_<K>", _body(47, 47))]))
def function_body(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return T.function_body(T.function_spans(lines), lines).select("path", "name", "body")


@query(golden("line_no:line comment", [(2, _body(1, 1)), (20, _body(18, 19)), (45, "// shown")]))
def leading_comments(spark, sf_dir):
    """The comment above every line that is none itself and has one."""
    lines = _lines(spark, sf_dir)
    return T.leading_comment(lines.filter("trim(code) <> ''"), lines)


@query(golden("directive condition depth:int branch:int start_line:line end_line:line", [("if", "0", 1, 1, 27, 27), ("ifdef", "FEATURE", 1, 1, 30, 30), ("else", "", 1, 2, 32, 32)]))
def conditional_regions(spark, sf_dir):
    return T.conditional_regions(_lines(spark, sf_dir)).select("path", "directive", "condition", F.col("depth").cast("int").alias("depth"), F.col("branch").cast("int").alias("branch"), "start_line", "end_line")


@query(golden("line_no:line stack", [(27, "if 0"), (32, "else ")]))
def ifdef_stack(spark, sf_dir):
    """The conditions around lines that hold two commas or a call with a null."""
    lines = _lines(spark, sf_dir)
    hits = lines.filter(F.col("code").rlike(r"\(1, 0\)|int y\)")).select("path", "line_no")
    shown = F.array_join(F.transform("ifdef_stack", lambda s: F.concat_ws(" ", s["directive"], s["condition"])), "|")
    return T.ifdef_stack(hits, lines).select("path", "line_no", shown.alias("stack"))


@query(golden("config line_no:line", [("none", 27), ("none", 30), ("on", 27), ("on", 32)]))
def inactive_lines(spark, sf_dir):
    configs = spark.createDataFrame([("none", {}), ("on", {"FEATURE": 1})], "config string, defines map<string,int>")
    return T.inactive_lines(_lines(spark, sf_dir), configs)


@query(golden("line_no:line name params body", [(4, "MAX_<K>", None, "<S>"), (5, "TWICE_<K>", None, "(MAX_<K> * 2)"), (6, "LONG_<K>", None, "1 + <S>"), (8, "CALL_<K>", "(x)", "x"), (9, "ALIAS_<K>", None, "TWICE_<K>")], ", false AS truncated"))
def define_blocks(spark, sf_dir):
    found = T.define_blocks(_lines(spark, sf_dir))
    return found.withColumn("body", F.regexp_replace("body", r"\s+", " "))


@query(f"WITH {P} SELECT 'MAX_' || k AS name, CAST(s AS BIGINT) AS value FROM p UNION ALL SELECT 'TWICE_' || k, 2 * s FROM p UNION ALL SELECT 'LONG_' || k, s + 1 FROM p UNION ALL SELECT 'CALL_' || k, NULL FROM p UNION ALL SELECT 'ALIAS_' || k, 2 * s FROM p")
def macro_values(spark, sf_dir):
    return T.macro_values(T.define_blocks(_lines(spark, sf_dir)))


@query(golden("root place:int name", [("TWICE_<K>", 1, "MAX_<K>"), ("ALIAS_<K>", 1, "TWICE_<K>"), ("ALIAS_<K>", 2, "MAX_<K>")]).replace("SELECT path, ", "SELECT "))
def alias_chain(spark, sf_dir):
    return T.alias_chain(T.define_blocks(_lines(spark, sf_dir)))


@query(golden("name value:int line_no:line", [("RED_<K>", 0, 11), ("BLUE_<K>", 1, 11), ("ODD_<K>", None, 12), ("LAST_<K>", None, 12)]).replace("v.value AS value", "CASE v.value WHEN 0 THEN 0 WHEN 1 THEN s + 1 END AS value") + f" UNION ALL SELECT path, 'GREEN_' || k, s, CAST(11 + d AS INT) FROM p")
def enum_members(spark, sf_dir):
    return T.enum_members(_lines(spark, sf_dir)).select("path", "name", "value", "line_no")


@query(golden("line_no:line label start_line:line end_line:line", [(37, "case ONE_<K>, case TWO_<K>", 35, 38), (40, "default", 39, 40), (24, "", 20, 28)]))
def case_blocks(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    hits = lines.filter(F.col("code").rlike(r"^\s+(helper|run)_\d+\(x|return other")).select("path", "line_no")
    return T.case_blocks(lines, hits)


DEFINITIONS = [
    ("MAX_<K>", "define", 4), ("TWICE_<K>", "define", 5), ("LONG_<K>", "define", 6), ("CALL_<K>", "define", 8), ("ALIAS_<K>", "define", 9), ("color_<K>", "enum", 11), ("node_<K>", "struct", 13),
    ("node_t_<K>", "typedef", 16), ("helper_<K>", "func", 20), ("dead_<K>", "func", 27), ("run_<K>", "func", 30), ("run_<K>", "func", 32), ("late_<K>", "func", 45),
    ("RED_<K>", "enum_member", 11), ("GREEN_<K>", "enum_member", 11), ("BLUE_<K>", "enum_member", 11), ("ODD_<K>", "enum_member", 12), ("LAST_<K>", "enum_member", 12),
]


@query(golden("name kind line_no:line", DEFINITIONS))
def extract_definitions(spark, sf_dir):
    return T.extract_definitions(_lines(spark, sf_dir)).select("path", "name", "kind", "line_no")


@query(golden("name line_no:line", [("count_<K>", 10), ("count_<K>", 23), ("count_<K>", 47)]))
def static_names(spark, sf_dir):
    return T.static_names(_lines(spark, sf_dir))


@query(golden("name target kind line_no:line", [("node_t_<K>", "node_<K>", "struct", 13)]))
def typedef_targets(spark, sf_dir):
    defs = T.line_definitions(_lines(spark, sf_dir))
    return T.typedef_targets(defs.filter("kind = 'typedef'"), defs)


CARDS = [
    ("MAX_<K>", "define", 4, _body(4, 4), 0, False), ("LONG_<K>", "define", 6, _body(6, 7), 1, False), ("node_<K>", "struct", 13, _body(13, 15), None, False), ("node_t_<K>", "typedef", 16, _body(16, 16), None, False),
    ("helper_<K>", "func", 20, _body(18, 25), None, False), ("late_<K>", "func", 45, _body(44, 45), None, True), ("GREEN_<K>", "enum_member", 11, _body(11, 11), 0, False), ("LAST_<K>", "enum_member", 12, _body(12, 12), None, False),
]


@query(golden("name kind line_no:line body value:s decl:int", CARDS))
def symbol_cards(spark, sf_dir):
    """The cards of eight names of every file."""
    lines = _lines(spark, sf_dir)
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"))
    words = keys.select(F.explode(F.array(*[F.concat(F.lit(n), "k") for n in ("MAX_", "LONG_", "node_", "node_t_", "helper_", "late_", "GREEN_", "LAST_")])).alias("name"))
    return T.symbol_cards(words, lines)


CALLS = [("helper_<K>", "other_<K>", 24), ("run_<K>", "helper_<K>", 37), ("run_<K>", "run_<J>", 40)]


def _calls(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return T.call_edges(T.dead_blocks(lines), T.function_spans(lines))


@query(golden("caller callee line_no:line", CALLS))
def call_edges(spark, sf_dir):
    return _calls(spark, sf_dir)


@query(golden("caller callee line_no:line kind", [(*c, k) for c, k in zip(CALLS, (None, "func", "func"), strict=True)]).replace("<J>', CAST(j", "<J>', CAST(j") + " WHERE TRUE")
def callees(spark, sf_dir):
    """Every call with the kind of what is called: run of the next part is a function wherever there is a next part."""
    kinds = T.line_definitions(_lines(spark, sf_dir)).select("name", "kind")
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("last"))
    known = kinds.union(last.select(F.concat(F.lit("run_"), (F.col("last") + 1).cast("string")), F.lit("func")))
    return R.callee_kinds(_calls(spark, sf_dir).withColumnRenamed("callee", "name"), known).withColumnRenamed("name", "callee")


@query(golden("func line_no:line indirect:int", [("run_<K>", 40, False), ("run_<K>", 32, True)]).replace("WITH", "WITH").replace("SELECT path, ", "SELECT path, ") + " WHERE v.line_no = 40 AND j = 8")
def callers(spark, sf_dir):
    """Who calls run of part 8; its mention at its own head is left out. All texts are searched for the word, and only files that hold it go on to the spans."""
    lines = T.code_lines(written(T.files_with(_files(spark, sf_dir), "run_8"), "files"))
    spans = T.function_spans(lines)
    mentions = R.enclosing_function(S.search(lines, "run_8", case=True, word=True).select("path", "line_no"), spans).select("path", "func", "line_no")
    return T.callers(T.call_edges(T.dead_blocks(lines), spans), mentions, "run_8")


@query(f"WITH {P} SELECT a.path AS src, 'src' || a.k % 7 || '/part_' || a.j || '.h' AS dst FROM p a UNION ALL SELECT path, 'sys/common.h' FROM p")
def resolve_includes(spark, sf_dir):
    """Includes among headers that stand beside each file; quoted ones are found there, angled ones anywhere."""
    files = _files(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    headers = part.select(F.concat(F.lit("src"), (F.col("p_partkey") % 7).cast("string"), F.lit("/part_"), (F.col("p_partkey") + 1).cast("string"), F.lit(".h")).alias("path"))
    known = headers.union(spark.createDataFrame([("sys/common.h",), ("z/sys/common.h",)], "path string"))
    return R.resolve_includes(R.include_edges(S.explode_lines(files)), known)


@query(f"WITH {P} SELECT 'sys/common.h' AS dst, path AS src FROM p")
def included_by(spark, sf_dir):
    return R.included_by(resolve_includes(spark, sf_dir), "common.h")


@query(golden("line_no:line kind", [(4, "define"), (13, "struct"), (20, "func"), (32, "func"), (45, "declaration")]))
def classify_hits(spark, sf_dir):
    """Kinds of hits by the lines behind them: a head that ends before a brace declares."""
    lines = S.explode_lines(_files(spark, sf_dir))
    hits = lines.filter(F.col("text").rlike(r"^#define MAX|^struct|^static int helper|int y\)|^int late"))
    return S.classify_hit(hits, lines).select("path", "line_no", "kind")


@query(golden("line_no:line", [(20,), (27,), (37,)]))
def code_hits(spark, sf_dir):
    """Where helper stands in code: neither in comments nor in strings."""
    lines = _lines(spark, sf_dir)
    return S.code_hits(S.search(lines, "helper_", case=True), lines, "helper_").select("path", "line_no")


@query(golden("word line_no:line", [("count_<K>", 10), ("other_<K>", 22), ("count_<K>", 23), ("other_<K>", 24), ("run_<K>", 32), ("helper_<K>", 37), ("run_<J>", 40)]))
def decl_pattern_filter(spark, sf_dir):
    """Sites of four names in the text, but for the first lines of functions: all inside functions, and at file scope those that don't look like a prototype of the name."""
    lines = _lines(spark, sf_dir)
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:other|helper|run|count)_\d+)\b"), F.lit(1))))
    sites = R.enclosing_function(lines.select("path", "line_no", "text", words.alias("word")), _spans(spark, sf_dir)).filter("line_no <> func_line OR func_line IS NULL")
    return S.decl_pattern_filter(sites, F.col("word")).select("path", "word", "line_no")


STATES = [("set_<K>", 3, None, "", None, "next", None, ""), ("step_<K>", 10, "IDLE_<K>", "case", "BUSY_<K>", None, None, ""), ("step_<K>", 14, "BUSY_<K>|WAIT_<K>", "", "DONE_<K>", None, None, "BUSY_<K>@10"), ("step_<K>", 20, None, "", None, "pick(s)", None, "")]
SHOWN = "func line_no:int from_states from_kind to_state to_expr via fell"


def _shown(found):
    fell = F.array_join(F.transform("fell", lambda f: F.concat(f["name"], F.lit("@"), f["set_line"].cast("string"))), "|")
    return found.select("path", "func", "line_no", F.array_join("from_states", "|").alias("from_states"), "from_kind", F.col("to").alias("to_state"), "to_expr", "via", fell.alias("fell"))


def _machine(spark, sf_dir):
    files = _files(spark, sf_dir, MACHINE)
    return files.withColumn("content", F.ltrim(F.regexp_replace("content", r"^\n+", "")))


@query(golden(SHOWN, STATES))
def code_transitions(spark, sf_dir):
    return _shown(X.code_transitions(_machine(spark, sf_dir), "st"))


@query(golden("line_no:int name set_line:int", [(14, "BUSY_<K>", 10)]))
def fell_through(spark, sf_dir):
    return X.fell_through(X.code_changes(_machine(spark, sf_dir), "st"))


@query(golden("func name arg_index:int", [("set_<K>", "s", 0), ("set_<K>", "next", 1), ("step_<K>", "s", 0)]))
def parameter_places(spark, sf_dir):
    return X.parameters(_machine(spark, sf_dir))


@query(golden(SHOWN, [("step_<K>", 17, "DONE_<K>", "case", "IDLE_<K>", None, "set_<K>", ""), ("step_<K>", 22, "PICK_<K>", "if", "WAIT_<K>", None, "set_<K>", "")]))
def helper_transitions(spark, sf_dir):
    """Constants given to functions that assign their parameter; a variable given is no transition."""
    return _shown(X.helper_transitions(_machine(spark, sf_dir), "st"))
