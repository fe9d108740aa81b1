"""Resolution queries over parts, suppliers and orders as tagged sources."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import resolve as R
from siltstone.operators import search as S
from siltstone.operators.joins import dealt
from siltstone.plans.common import LINES
from siltstone.plans.registry import query
from siltstone.sources import table

KIND = "CASE p_size % 3 WHEN 0 THEN 'func' WHEN 1 THEN 'define' ELSE 'struct' END"
PATH = "p_brand || '/' || p_type || '/' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.h' WHEN 2 THEN '.cpp' ELSE '.txt' END"
DEFS = f"defs AS (SELECT split_part(p_name, ' ', 1) || p_size % 7 AS name, {KIND} AS kind, {PATH} AS path, p_size % 5 < 3 AS is_def, p_partkey FROM part)"


def defs(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "func").when(size % 3 == 1, "define").otherwise("struct")
    end = F.when(size % 4 == 0, ".c").when(size % 4 == 1, ".h").when(size % 4 == 2, ".cpp").otherwise(".txt")
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), end)
    name = F.concat(F.substring_index("p_name", " ", 1), (size % 7).cast("string"))
    return table(spark, sf_dir, "part").select(name.alias("name"), kind.alias("kind"), path.alias("path"), (size % 5 < 3).alias("is_def"), "p_partkey")


@query(f"WITH {DEFS}, every AS (SELECT name, path, 'tags' AS engine, 0 AS p FROM defs WHERE p_partkey % 50 = 1 UNION ALL SELECT name, path, 'xref', 1 FROM defs WHERE p_partkey % 30 = 2 UNION ALL SELECT name, path, 'scan', 2 FROM defs) SELECT name, path, engine FROM every e WHERE p = (SELECT min(p) FROM every x WHERE x.name = e.name)")
def first_engine(spark, sf_dir):
    d = defs(spark, sf_dir).select("name", "path", "p_partkey")
    return R.first_engine([("tags", d.filter("p_partkey % 50 = 1")), ("xref", d.filter("p_partkey % 30 = 2")), ("scan", d)]).select("name", "path", "engine")


@query(f"WITH {DEFS}, a AS (SELECT * FROM (SELECT *, max(is_def::INT) OVER (PARTITION BY name) AS d FROM defs) WHERE d = 0 OR is_def), b AS (SELECT *, max((path LIKE '%.c' OR path LIKE '%.cpp')::INT) OVER (PARTITION BY name, kind) AS i FROM a) SELECT name, kind, path FROM b WHERE i = 0 OR path LIKE '%.c' OR path LIKE '%.cpp'")
def prefer_definition(spark, sf_dir):
    return R.prefer_definitions(defs(spark, sf_dir)).select("name", "kind", "path")


SCORED = f"""{DEFS}, calls AS (SELECT path AS caller_path, name AS callee FROM defs UNION SELECT path, 'unknown' FROM defs),
scored AS (SELECT c.*, d.path, d.kind, CASE WHEN d.path IS NOT NULL THEN CASE d.kind WHEN 'func' THEN 100 WHEN 'define' THEN 50 ELSE 0 END + CASE WHEN d.path LIKE '%.c' OR d.path LIKE '%.cpp' THEN 10 WHEN d.path LIKE '%.h' THEN 5 ELSE 0 END
  + CASE WHEN split_part(c.caller_path, '/', 1) <> split_part(d.path, '/', 1) THEN 0 WHEN split_part(c.caller_path, '/', 2) <> split_part(d.path, '/', 2) THEN 100 ELSE 1000 END END AS score FROM calls c LEFT JOIN defs d ON d.name = c.callee),
ranked AS (SELECT *, row_number() OVER w AS k, score - lead(score) OVER w AS gap, count(path) OVER (PARTITION BY caller_path, callee) AS candidates, count(path) FILTER (kind = 'define') OVER (PARTITION BY caller_path, callee) AS defines, count(path) FILTER (kind = 'struct') OVER (PARTITION BY caller_path, callee) AS structs FROM scored WINDOW w AS (PARTITION BY caller_path, callee ORDER BY score DESC NULLS LAST, path))"""


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 <> 0 THEN p_type END AS kind FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def left_unknown_kept(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("kind"))
    callees = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("name"), "l_suppkey")
    return R.callee_kinds(callees, known).withColumnRenamed("name", "l_partkey")


SPANS = LINES + ", spans AS (SELECT path, 'outer' || line_no AS name, line_no AS start_line, line_no + 8 AS end_line FROM lines WHERE line_no % 12 = 1 UNION ALL SELECT path, 'inner' || line_no, line_no, line_no + 1 FROM lines WHERE line_no % 12 = 4)"


def spans(lines):
    n = F.col("line_no")
    outer = lines.filter(n % 12 == 1).select("path", F.concat(F.lit("outer"), n.cast("string")).alias("name"), n.alias("start_line"), (n + 8).alias("end_line"))
    return outer.unionByName(lines.filter(n % 12 == 4).select("path", F.concat(F.lit("inner"), n.cast("string")).alias("name"), n.alias("start_line"), (n + 1).alias("end_line")))


@query(f"WITH {SPANS} SELECT l.path, l.line_no, arg_max(s.name, s.start_line) AS func FROM lines l LEFT JOIN spans s ON s.path = l.path AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY l.path, l.line_no")
def enclosing_function(spark, sf_dir):
    lines = S.explode_lines(S.document_files(table(spark, sf_dir, "documents")))
    return R.enclosing_function(lines.select("path", "line_no"), spans(lines)).select("path", "line_no", "func")


ORDERS = "sites AS (SELECT o_orderpriority AS value, 'c' || o_custkey % 40 AS func, n_name AS path, CAST(o_orderkey AS INT) AS line_no FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


def sites(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return orders.select(F.col("o_orderpriority").alias("value"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("func"), F.col("n_name").alias("path"), F.col("o_orderkey").cast("int").alias("line_no"))


@query(f"WITH {ORDERS} SELECT value AS key, count(*) AS n, array_to_string(list_slice(list(path || ':' || line_no ORDER BY path, line_no), 1, 2), ',') AS samples FROM sites GROUP BY value")
def group_refs(spark, sf_dir):
    return R.group_refs(sites(spark, sf_dir), "value").withColumn("samples", F.array_join("samples", ","))


@query(f"WITH {ORDERS} SELECT value AS \"outer\", func AS \"inner\", CASE WHEN count(DISTINCT path) = 1 THEN min(path) ELSE '' END AS file, count(*) AS n, array_to_string(list_slice(list(line_no ORDER BY line_no), 1, 40), ',') AS lines, count(*) > 40 AS truncated FROM sites GROUP BY 1, 2")
def group_refs_two_level(spark, sf_dir):
    return R.group_refs2(sites(spark, sf_dir), "value", "func").withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query(f"WITH {ORDERS}, s AS (SELECT path, CASE WHEN line_no % 4 <> 0 THEN func END AS func, line_no FROM sites) SELECT path, func, min(line_no) AS line_no FROM s WHERE func IS NOT NULL AND func <> 'c7' GROUP BY path, func UNION ALL SELECT DISTINCT path, NULL, line_no FROM s WHERE func IS NULL")
def callers_dedup(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("func", F.when(F.col("line_no") % 4 != 0, F.col("func")))
    return R.callers_dedup(s, "c7")


@query(f"WITH {ORDERS}, a AS (SELECT DISTINCT path, line_no FROM sites WHERE line_no % 3 <> 0), b AS (SELECT DISTINCT path, line_no FROM sites WHERE line_no % 5 <> 0) SELECT coalesce(a.path, b.path) AS path, coalesce(a.line_no, b.line_no) AS line_no, a.path IS NOT NULL AS in_callers, b.path IS NOT NULL AS in_refs FROM a FULL JOIN b ON a.path = b.path AND a.line_no = b.line_no")
def compare_callers_refs(spark, sf_dir):
    s = sites(spark, sf_dir)
    return R.compare_callers_refs(s.filter("line_no % 3 <> 0"), s.filter("line_no % 5 <> 0"))


@query("SELECT count(*) AS n_stale, max(o_orderdate) AS newest FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def stale_files(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    return R.stale_files(files, F.expr("TIMESTAMP '1998-01-01'"))


@query(f"WITH {DEFS} SELECT h.path AS header, s.path AS source FROM (SELECT path, p_partkey % 97 AS stem FROM defs WHERE path LIKE '%.h') h JOIN (SELECT path, p_partkey % 97 AS stem FROM defs WHERE path LIKE '%.c' OR path LIKE '%.cpp') s USING (stem)")
def sibling_sources(spark, sf_dir):
    d = defs(spark, sf_dir)
    named = d.select(F.col("path").alias("full"), F.concat(F.lit("d/"), (F.col("p_partkey") % 97).cast("string"), F.regexp_extract("path", r"(\.\w+)$", 1)).alias("path"))
    pairs = R.sibling_sources(named.filter("path LIKE '%.h'").select("path").distinct(), named.select("path").distinct())
    a, b = named.select(F.col("full").alias("h"), F.col("path").alias("header")), named.select(F.col("full").alias("s"), F.col("path").alias("source"))
    # few rows here make many behind the last join, whose tasks are those of the rows dealt
    return dealt(pairs.join(a, "header").select("h", "source"), "h").join(b, "source").select(F.col("h").alias("header"), F.col("s").alias("source"))


@query(f"WITH {DEFS} SELECT DISTINCT a.path AS a, b.path AS b FROM defs a JOIN defs b ON a.name = b.name WHERE a.p_partkey < b.p_partkey AND split_part(a.path, '/', 1) = split_part(b.path, '/', 1) AND split_part(a.path, '/', 2) = split_part(b.path, '/', 2)")
def in_subtree(spark, sf_dir):
    d = defs(spark, sf_dir).select("name", "path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "p_partkey").distinct()
    d = d.withColumn("many", F.count("*").over(Window.partitionBy("path")) > 1)
    side = lambda df, x: df.select("name", "folder", F.col("path").alias(x), F.col("p_partkey").alias(f"k{x}"), F.col("many").alias(f"m{x}"))
    pairs = R.subtree_pairs(side(d, "a"), side(d, "b")).filter("ka < kb AND NOT (ma AND mb)").select("a", "b")
    # only paths with several rows each can meet more than once
    many = d.filter("many")
    return pairs.unionByName(R.subtree_pairs(side(many, "a"), side(many, "b")).filter("ka < kb").select("a", "b").distinct())


@query(f"WITH {DEFS} SELECT name, kind, path FROM defs WHERE name IN (SELECT name FROM defs)")
def definitions_all(spark, sf_dir):
    d = defs(spark, sf_dir)
    return R.definitions(d, d).select("name", "kind", "path")


@query(f"""WITH {DEFS}, words AS (SELECT name, path AS current FROM defs), j AS (SELECT w.name, w.current, d.path, CASE WHEN d.is_def THEN CASE
  WHEN split_part(w.current, '/', 1) <> split_part(d.path, '/', 1) THEN 2 WHEN split_part(w.current, '/', 2) <> split_part(d.path, '/', 2) THEN 1 ELSE 0 END ELSE 2 END AS level FROM words w JOIN defs d ON d.name = w.name)
SELECT name, current, path, level FROM j x WHERE level = (SELECT min(level) FROM j y WHERE y.name = x.name AND y.current = x.current)""")
def nearest_level_all(spark, sf_dir):
    d = defs(spark, sf_dir)
    return R.nearest_definition(d.select("name", F.col("path").alias("current")), d.select("name", "path", "is_def")).select("name", "current", "path", "level")


@query(f"WITH {SCORED} SELECT caller_path, callee, path, score, candidates, CASE WHEN candidates = 0 THEN 'low' WHEN candidates = 1 OR score >= 1000 OR gap >= 100 THEN 'high' WHEN score >= 100 THEN 'medium' ELSE 'low' END AS confidence, defines = candidates AS likely_macro, candidates > 0 AND structs = candidates AS likely_non_callable FROM ranked WHERE k = 1")
def rank_definition_all(spark, sf_dir):
    d = defs(spark, sf_dir)
    calls = d.select(F.col("path").alias("caller_path"), F.col("name").alias("callee"))
    calls = calls.union(d.select("path", F.lit("unknown"))).distinct()
    return R.rank_callee_definition(calls, d.select("name", "path", "kind")).select("caller_path", "callee", "path", "score", "candidates", "confidence", "likely_macro", "likely_non_callable")


RULED = """made AS (SELECT *, 'f' || p_partkey AS word, 'p/' || p_partkey || '.c' AS file, p_size % 25 AS gap FROM part), judged AS (SELECT word AS name, CASE p_size % 6 WHEN 4 THEN 'define' ELSE 'func' END AS kind, file AS path, 2 AS line_no,
  CASE p_size % 6 WHEN 1 THEN false WHEN 5 THEN gap >= 20 OR p_size % 2 = 0 ELSE true END AS is_def, p_size % 6 = 2 AS wrong_name, p_size % 6 = 3 AS annotation FROM made)"""


@query(f"WITH {RULED} SELECT * FROM judged")
def definition_rules(spark, sf_dir):
    """A file for each part, whose second line names its word: a function, a prototype, another function's annotation, a line of annotations, a macro, or a header of as many lines as the size says."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".c")).alias("path"), "p_size")
    form, gap, word = F.col("p_size") % 6, F.col("p_size") % 25, F.col("name")
    texts = (
        F.when(form == 0, F.array(F.concat(F.lit("int "), word, F.lit("(int a) // ends;")), F.lit("{")))
        .when(form == 1, F.array(F.concat(F.lit("int "), word, F.lit("(int a); // {")), F.lit("int next(void) {")))
        .when(form == 2, F.array(F.concat(F.lit("int other(int a) "), word, F.lit("(lock)")), F.lit("{")))
        .when(form == 3, F.array(F.concat(F.lit("void "), word, F.lit("(&x->lock)")), F.lit(""), F.lit("real_name(struct x *x)"), F.lit("{")))
        .when(form == 4, F.array(F.concat(F.lit("#define "), word, F.lit("(a) a;"))))
        .otherwise(F.concat(F.array(F.concat(F.lit("int "), word, F.lit("(int a,"))), F.array_repeat(F.lit("    int b,"), gap), F.array(F.when(F.col("p_size") % 2 == 0, F.lit("    int c) {")).otherwise(F.lit("    int c);")))))
    )
    lines = part.select("path", F.posexplode(F.concat(F.array(F.lit("#include <x.h>")), texts)).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)
    hits = part.select("name", F.when(form == 4, "define").otherwise("func").alias("kind"), "path", F.lit(2).alias("line_no"))
    return R.judge_definitions(hits, lines)
