"""State queries over events; annotation queries over pinned lines of documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import annotations as A
from siltstone.operators import resolve as R
from siltstone.operators import search as S
from siltstone.operators import states as X
from siltstone.plans.common import FILES, LINES
from siltstone.plans.registry import query
from siltstone.sources import table

STEPS = "moves AS (SELECT user_id, event_id, prev AS \"from\", event_type AS \"to\" FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL)"
TYPES = ["click", "error", "purchase", "signup", "view"]


def _moves(spark, sf_dir):
    return X.event_transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "from", "to")


@query(f"WITH {STEPS} SELECT * FROM moves")
def transitions(spark, sf_dir):
    return _moves(spark, sf_dir)


@query(f"WITH {STEPS} SELECT \"from\", " + ", ".join(f"count(*) FILTER (\"to\" = '{t}') AS \"{t}\"" for t in TYPES) + " FROM moves GROUP BY \"from\"")
def transition_matrix(spark, sf_dir):
    return X.transition_matrix(_moves(spark, sf_dir), TYPES)


@query(f"WITH {STEPS} SELECT \"from\", string_agg(DISTINCT \"to\", ',' ORDER BY \"to\") AS to_states, count(*) AS n FROM moves GROUP BY \"from\"")
def successors(spark, sf_dir):
    return X.successors(_moves(spark, sf_dir)).withColumn("to_states", F.array_join("to_states", ","))


@query(f"WITH {STEPS} SELECT name, name IN (SELECT \"to\" FROM moves) AS assigned, name IN (SELECT \"to\" FROM moves UNION SELECT \"from\" FROM moves) AS observed FROM (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'never')")
def dead_states(spark, sf_dir):
    universe = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).union(spark.createDataFrame([("never",)], "name string"))
    return X.dead_states(universe, _moves(spark, sf_dir))


@query(f"WITH {STEPS} SELECT coalesce(CASE WHEN event_id % 7 <> 0 THEN \"from\" END, '') AS \"from\", \"to\", user_id % 3 AS func, '' AS via, count(*) AS n, count(DISTINCT event_id % 50) AS n_lines, bool_or(event_id % 5 = 0 AND event_id % 7 <> 0) AS fell_through FROM moves GROUP BY 1, 2, 3")
def state_summary(spark, sf_dir):
    known = F.col("event_id") % 7 != 0
    rows = _moves(spark, sf_dir).select(F.when(known, F.array("from")).alias("from_states"), "to", (F.col("user_id") % 3).alias("func"), F.lit("").alias("via"), (F.col("event_id") % 50).alias("line_no"), F.when((F.col("event_id") % 5 == 0) & known, F.array("from")).otherwise(F.array().cast("array<string>")).alias("fell"))
    return X.state_summary(rows).withColumn("n_lines", F.size("lines").cast("long")).drop("lines")


#: Right sides made of an event type, and what each is: one balanced pair of brackets comes off, no more.
RHS = [("T", "state", "T"), ("( T )", "state", "T"), ("((T))", "expr", "((T))"), ("T)", "expr", "T)"), ("(T", "expr", "(T"), ("(T + 1)", "expr", "T + 1"), ("(a ? T : B)", "expr", "a ? T : B"), ("f(T)", "expr", "f(T)"), ("(f(T))", "expr", "(f(T))"), ("\tT ", "state", "T"), ("2", "expr", "2")]


def _sql_text(text):
    return "'" + text.replace("\t", "' || chr(9) || '") + "'"


@query("SELECT event_id, CAST(event_id % 11 AS INT) AS form, v.kind, replace(v.value, 'T', upper(event_type)) AS value FROM events JOIN (VALUES " + ", ".join(f"({i}, '{kind}', {_sql_text(value)})" for i, (_, kind, value) in enumerate(RHS)) + ") v(form, kind, value) ON v.form = event_id % 11")
def classify_rhs(spark, sf_dir):
    form = (F.col("event_id") % len(RHS)).cast("int")
    rhs = F.replace(F.get(F.array(*[F.lit(text) for text, _, _ in RHS]), form), F.lit("T"), F.upper("event_type"))
    return table(spark, sf_dir, "events").select("event_id", form.alias("form"), X.classify_rhs(rhs).alias("c")).select("event_id", "form", "c.kind", "c.value")


@query("SELECT name, value, row_number() OVER (ORDER BY TRY_CAST(value AS BIGINT) NULLS LAST, name) AS place FROM (SELECT p_type || p_size AS name, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS value FROM part GROUP BY 1, 2)")
def order_states(spark, sf_dir):
    states = table(spark, sf_dir, "part").select(F.concat("p_type", F.col("p_size").cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("value")).distinct()
    return X.order_states(states).withColumn("place", F.col("place").cast("long"))


@query("SELECT (u.size <= 3 * seen + 4) AND NOT (valued >= 4 AND 3 * (valued - vals) > valued) AS plausible, size, seen FROM (SELECT count(*) AS size, count(v) AS valued, count(DISTINCT v) AS vals FROM (SELECT DISTINCT p_type AS name, length(p_type) AS v FROM part)) u, (SELECT count(DISTINCT event_type) AS seen FROM events)")
def plausible_universe(spark, sf_dir):
    universe = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.length("p_type").alias("value")).distinct()
    return X.plausible_universe(universe, table(spark, sf_dir, "events").select(F.col("event_type").alias("name")))


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS value, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 20 MINUTE AS fresh FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return X.latest_state(events, "user_id", F.struct("ts", "event_id"), "event_type", "ts", now, "20 minutes").select("user_id", "value", "fresh")


NOTES = LINES + ", notes AS (SELECT path || '::' || (line_no + 1) AS key, path, line_no + 1 AS line_no, text AS pinned FROM lines WHERE line_no % 5 = 0)"


def notes(spark, sf_dir):
    lines = S.explode_lines(S.document_files(table(spark, sf_dir, "documents")))
    at = F.col("line_no") + 1
    return lines.filter("line_no % 5 = 0").select(F.concat("path", F.lit("::"), at.cast("string")).alias("key"), "path", at.alias("line_no"), F.col("text").alias("pinned")), lines


KEY = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
HEALED = NOTES + f""", keyed AS (SELECT path, line_no, {KEY.format('text')} AS k FROM lines),
healed AS (SELECT n.*, CASE WHEN regexp_matches(m.k, '[^\\p{{L}}\\p{{Nd}}_]') THEN CASE WHEN h.k = m.k THEN n.line_no WHEN c.n = 1 THEN c.only END END AS new_line
  FROM notes n JOIN (SELECT key, {KEY.format('pinned')} AS k FROM notes) m ON m.key = n.key LEFT JOIN keyed h ON h.path = n.path AND h.line_no = n.line_no
  LEFT JOIN (SELECT path, k, count(*) AS n, min(line_no) AS only FROM keyed GROUP BY path, k) c ON c.path = n.path AND c.k = m.k)"""


@query(f"WITH {HEALED} SELECT key, path, line_no, new_line FROM healed")
def heal_anchors(spark, sf_dir):
    pinned, lines = notes(spark, sf_dir)
    return A.heal_anchors(pinned, lines).drop("pinned")


@query(f"WITH {NOTES} SELECT n.key, CASE WHEN NOT EXISTS (SELECT 1 FROM files f WHERE f.path = n.path) THEN 'file_gone' WHEN l.text IS NULL THEN 'line_missing' WHEN trim(l.text) = trim(n.pinned) THEN 'kept' ELSE 'drifted' END AS status FROM notes n LEFT JOIN lines l ON l.path = n.path AND l.line_no = n.line_no")
def drifted(spark, sf_dir):
    pinned, lines = notes(spark, sf_dir)
    return A.drifted(pinned, lines, lines.select("path")).select("key", "status")


@query(f"WITH {HEALED}, moved AS (SELECT h.key, h.path, h.line_no, h.new_line FROM healed h LEFT JOIN lines l ON l.path = h.path AND l.line_no = h.line_no WHERE (l.text IS NULL OR trim(l.text) <> trim(h.pinned)) AND h.new_line <> h.line_no AND NOT EXISTS (SELECT 1 FROM notes o WHERE o.path = h.path AND o.line_no = h.new_line)) SELECT key, path, line_no, new_line FROM (SELECT *, row_number() OVER (PARTITION BY path, new_line ORDER BY key) AS k FROM moved) WHERE k = 1")
def unique_heal(spark, sf_dir):
    pinned, lines = notes(spark, sf_dir)
    return A.unique_heal(pinned, lines, lines.select("path"))


def _edits(pinned):
    """Lines 4 to 7 of every file go, then two lines come in before line 3; given out of order."""
    edit = lambda seq, line, delta: F.struct(F.lit(seq).alias("seq"), F.lit(line).alias("from_line"), F.lit(delta).alias("delta"))
    return pinned.select("path").distinct().select("path", F.explode(F.array(edit(2, 3, 2), edit(1, 8, -4))).alias("e")).select("path", "e.*")


@query(f"""WITH {NOTES}, one AS (SELECT key, path, line_no, CASE WHEN line_no BETWEEN 4 AND 7 THEN NULL WHEN line_no > 7 THEN line_no - 4 ELSE line_no END AS mid FROM notes),
two AS (SELECT *, CASE WHEN mid > 2 THEN mid + 2 ELSE mid END AS new_line FROM one)
SELECT key, path, line_no, new_line, CASE WHEN new_line IS NULL THEN 'dropped' WHEN new_line <> line_no THEN 'moved' ELSE 'same' END AS fate FROM two""")
def shift_points(spark, sf_dir):
    pinned, _ = notes(spark, sf_dir)
    return A.shift_points(pinned.drop("pinned"), _edits(pinned))


#: A range of lines is followed line by line: what is left of it after the deletion, one line or more, moves with its first and last line.
@query(f"""WITH {NOTES}, r AS (SELECT key, line_no AS s, line_no + n % 9 AS e FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY key) - 1 AS n FROM notes)),
left_over AS (SELECT key, s, e, list_filter(range(s, e + 1), lambda i: NOT (i BETWEEN 4 AND 7)) AS held FROM r),
mid AS (SELECT key, CASE WHEN len(held) > 0 THEN CASE WHEN s BETWEEN 4 AND 7 THEN 4 WHEN held[1] > 7 THEN held[1] - 4 ELSE held[1] END END AS s, CASE WHEN len(held) > 0 THEN CASE WHEN held[-1] > 7 THEN held[-1] - 4 ELSE held[-1] END END AS e FROM left_over)
SELECT key, CAST(CASE WHEN s > 2 THEN s + 2 ELSE s END AS INT) AS new_start, CAST(CASE WHEN e > 2 THEN e + 2 ELSE e END AS INT) AS new_end FROM mid""")
def shift_ranges(spark, sf_dir):
    pinned, _ = notes(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("path").orderBy("key")) - 1
    ranges = pinned.withColumn("n", n).select("key", "path", F.col("line_no").alias("start_line"), (F.col("line_no") + F.col("n") % 9).alias("end_line"))
    return A.shift_ranges(ranges, _edits(pinned)).select("key", "new_start", "new_end")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'insert' WHEN o_orderkey % 10 = 1 THEN 'delete' ELSE 'update' END AS change FROM orders WHERE o_orderkey % 10 < 3")
def change_feed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = orders.filter("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return A.change_feed(orders.filter("o_orderkey % 10 <> 0"), after, ["o_orderkey"])


@query(f"""WITH {FILES}, n AS (SELECT doc_id AS node, text AS memo FROM documents), e AS (SELECT doc_id % 50 AS src, doc_id AS dst FROM documents WHERE doc_id >= 50),
m AS (SELECT source || '/' || doc_id AS path, CASE WHEN quality = 0 THEN ' [Unverified] check' ELSE 'fine' END AS memo FROM documents JOIN labels USING (doc_id)),
f AS (SELECT * FROM n WHERE node NOT IN (SELECT dst FROM e))
SELECT 'nodes' AS item, '' AS label, count(*) AS n FROM n UNION ALL SELECT 'line_memos', '', count(*) FROM m UNION ALL SELECT 'unverified', '', count(*) FROM m WHERE starts_with(trim(memo), '[Unverified]')
UNION ALL SELECT 'outside_root', '', count(*) FROM m WHERE NOT starts_with(path, 'src1/') UNION ALL SELECT 'roots_total', '', count(*) FROM f
UNION ALL (SELECT 'root:' || node, substr(memo, 1, 120), (SELECT count(DISTINCT dst) FROM e WHERE src = node) FROM f ORDER BY node LIMIT 10)""")
def digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select(F.col("doc_id").alias("node"), F.col("text").alias("memo"))
    edges = docs.filter("doc_id >= 50").select((F.col("doc_id") % 50).alias("src"), F.col("doc_id").alias("dst"))
    memo = F.when(F.col("quality") == 0, " [Unverified] check").otherwise("fine")
    memos = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), memo.alias("memo"))
    return A.digest(nodes, edges, memos, "SRC1/")


@query("SELECT source AS path, CAST(doc_id AS INT) AS start_line, CAST(doc_id AS INT) AS end_line, lang AS memo, 'q' || quality AS category, 'line' AS source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 UNION ALL SELECT source, CAST(doc_id AS INT), CAST(doc_id + 3 AS INT), lang, 'q0', 'range' FROM documents WHERE doc_id % 6 = 1")
def list_annotations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.col("doc_id").cast("int").alias("line_no"), F.col("lang").alias("memo"))
    points = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("category", F.concat(F.lit("q"), F.col("quality").cast("string")))
    ranges = docs.filter("doc_id % 6 = 1").withColumn("start_line", F.col("line_no")).withColumn("end_line", F.col("line_no") + 3).withColumn("category", F.lit("q0"))
    return A.list_annotations(points, ranges, category="q0")


@query("SELECT conv_id, turn, mark FROM (SELECT conv_id, turn, CAST((conv_id + turn) % 7 AS INT) AS mark FROM conversations) WHERE mark IN (0, 1, 2, 3)")
def unverified_memos(spark, sf_dir):
    """Turns as memos behind one of seven beginnings; the first four say that nobody has checked."""
    mark = ((F.col("conv_id") + F.col("turn")) % 7).cast("int")
    start = F.get(F.array(*map(F.lit, ("[未確認]", " [Unverified] ", "\t[INFERRED]", "[推測] ", "todo ", "see [unverified] ", "? "))), mark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", mark.alias("mark"), F.concat(start, F.coalesce("text", F.lit(""))).alias("memo"))
    return A.unverified(turns).select("conv_id", "turn", "mark")


@query("SELECT o_orderkey AS key, CAST(o_custkey AS INT) AS line_no, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS memo, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 0 THEN 'old' ELSE 'old' END AS pinned FROM orders WHERE o_orderkey % 8 <> 0 OR o_orderkey % 4 = 0")
def upsert_annotations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").cast("int").alias("line_no"), F.col("o_orderstatus").alias("memo"), F.col("o_orderpriority").alias("text"))
    old = orders.filter("key % 8 <> 0").withColumn("pinned", F.lit("old"))
    new = orders.filter("key % 4 = 0").withColumn("memo", F.lit("new"))
    return A.upsert_annotations(old, new, orders).select("key", "line_no", "memo", "pinned")


@query("SELECT 'd' || doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN lang END AS memo, CASE WHEN doc_id % 3 = 0 THEN source END AS category, CASE WHEN doc_id % 5 = 0 THEN lang || source END AS source, CASE WHEN doc_id % 7 = 0 THEN 'pin' END AS pinned FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0")
def memo_join(spark, sf_dir):
    """Four maps that hold every second, third, fifth and seventh document."""
    docs = table(spark, sf_dir, "documents").withColumn("key", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    of = lambda n, value: docs.filter(F.col("doc_id") % n == 0).select("key", value.alias("value"))
    return A.memo_join(of(2, F.col("lang")), of(3, F.col("source")), of(5, F.concat("lang", "source")), of(7, F.lit("pin")))


@query("SELECT p_type AS name, CAST(min(length(p_type)) AS VARCHAR) AS value, 'enum' AS family, false AS truncated FROM part WHERE p_type IN ('PROMO', 'SMALL') OR EXISTS (SELECT 1 FROM part q WHERE q.p_type IN ('PROMO', 'SMALL')) GROUP BY p_type")
def state_universe(spark, sf_dir):
    """All types, for two of them are seen and they stand in one enum."""
    part = table(spark, sf_dir, "part")
    enums = part.select(F.lit("t").alias("enum"), F.col("p_type").alias("name"), F.length("p_type").alias("value")).distinct()
    observed = part.filter("p_type IN ('PROMO', 'SMALL')").select(F.col("p_type").alias("name"))
    return X.state_universe(observed, enums, spark.createDataFrame([("PRO_X", 1)], "name string, value int"))


@query(f"""WITH {LINES}, refs AS (SELECT 'license' AS name, path, line_no FROM lines WHERE line_no % 2 = 0), stale AS (SELECT path FROM files WHERE path LIKE '%/en/%'),
fresh AS (SELECT DISTINCT w AS name, path, line_no FROM (SELECT path, line_no, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM lines WHERE path LIKE '%/en/%') WHERE w IN ('license', 'version'))
SELECT name, path, line_no FROM refs WHERE path NOT IN (SELECT path FROM stale) UNION ALL SELECT name, path, line_no FROM fresh""")
def regather(spark, sf_dir):
    """References of stale files taken anew from their lines."""
    lines = S.explode_lines(S.document_files(table(spark, sf_dir, "documents"))).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    refs = lines.filter("line_no % 2 = 0").select(F.lit("license").alias("name"), "path", "line_no")
    names = spark.createDataFrame([("license",), ("version",)], "name string")
    return R.regather(refs, lines.filter("path LIKE '%/en/%'").select("path"), lines, names)
