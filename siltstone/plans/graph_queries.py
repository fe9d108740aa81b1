"""Graph queries over part successions (part n of an order to part n + 1) and page links."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.operators import graphs as G
from siltstone.operators import resolve as R
from siltstone.plans.registry import query
from siltstone.sources import table
from siltstone.sources.scratch import cut

STEPS = "steps AS (SELECT DISTINCT l_partkey AS src, nxt AS dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"


def steps(spark, sf_dir):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(by).alias("dst")).filter("dst IS NOT NULL").distinct()


def _nodes(edges):
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


@query(f"WITH RECURSIVE {STEPS}, walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN steps s ON s.src = w.node WHERE w.depth < 2) SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def reach_depth_n(spark, sf_dir):
    return G.closure(steps(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), 2)


TREE = """, r0 AS (SELECT CAST(300 AS BIGINT) AS node), t1 AS (SELECT 300 AS parent, src AS node, 1 AS depth FROM dag WHERE dst = 300),
n1 AS (SELECT DISTINCT node FROM t1 WHERE node <> 300), t2 AS (SELECT dst AS parent, src AS node, 2 AS depth FROM dag WHERE dst IN (SELECT node FROM n1)),
n2 AS (SELECT DISTINCT node FROM t2 WHERE node <> 300 AND node NOT IN (SELECT node FROM n1)), t3 AS (SELECT dst AS parent, src AS node, 3 AS depth FROM dag WHERE dst IN (SELECT node FROM n2)),
every AS (SELECT *, CASE depth WHEN 1 THEN node = 300 WHEN 2 THEN node = 300 OR node IN (SELECT node FROM n1) ELSE node = 300 OR node IN (SELECT node FROM n1) OR node IN (SELECT node FROM n2) END AS old, row_number() OVER (PARTITION BY depth, node ORDER BY parent) AS k FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3))
SELECT CAST(parent AS BIGINT) AS parent, node, depth, CASE WHEN old OR k > 1 THEN 'already_visited' WHEN depth = 3 AND node IN (SELECT dst FROM dag) THEN 'depth_limit' END AS stop FROM every"""


@query(f"WITH RECURSIVE {STEPS}, walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN steps s ON s.src = w.node WHERE w.depth < 4) SELECT count(*) > 0 AS found, CAST(min(depth) AS INT) AS hops FROM walk WHERE node = 150")
def shortest_path(spark, sf_dir):
    return G.call_path(steps(spark, sf_dir), 1, 150, 4).select("found", "hops")


@query("SELECT user_id AS session, src, event_type AS dst FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events) WHERE src <> event_type GROUP BY ALL")
def trail_edges(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("item"))
    return G.trail_edges(events)


def links(spark, sf_dir):
    """(src, dst): hrefs of pages, root-relative ones normalised under their host."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    own = F.concat(host, F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1))
    href = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"#?]+)'), F.lit(1)))
    return pages.select(own.alias("src"), host.alias("host"), href.alias("href")).select("src", F.concat("host", F.lit("/"), C.normalize_path("href")).alias("dst")).distinct()


LINKS = r"""links AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS src, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || trim(href, '/') AS dst FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS href FROM pages))"""


@query(f"WITH {LINKS} SELECT src, dst FROM links")
def link_graph(spark, sf_dir):
    return links(spark, sf_dir)


@query(f"""WITH {LINKS}, ends AS (SELECT src AS id FROM links UNION SELECT dst FROM links), sizes AS (SELECT (SELECT count(*) FROM ends) AS n, (SELECT count(*) FROM links) AS e)
SELECT 'node' AS part, id AS a, regexp_extract(id, '[^/]*$') AS b, CAST(NULL AS BOOLEAN) AS truncated FROM (SELECT id FROM ends ORDER BY id LIMIT 100) UNION ALL SELECT 'edge', src, dst, NULL FROM (SELECT * FROM links ORDER BY src, dst LIMIT 200)
UNION ALL SELECT 'sizes', CAST(n AS VARCHAR), CAST(e AS VARCHAR), n > 100 OR e > 200 FROM sizes""")
def dependency_graph(spark, sf_dir):
    """The graph of links to show: its first nodes and edges, and whether there are more."""
    nodes, edges, sizes = R.dependency_graph(links(spark, sf_dir))
    none = F.lit(None).cast("boolean").alias("truncated")
    rows = nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("b"), none).union(edges.select(F.lit("edge"), "src", "dst", none))
    return rows.union(sizes.select(F.lit("sizes"), F.col("nodes").cast("string"), F.col("edges").cast("string"), "truncated"))


@query(f"WITH {LINKS} SELECT dst, count(*) AS n_sources FROM links GROUP BY dst")
def linked_by(spark, sf_dir):
    return links(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("n_sources"))


FORWARD = STEPS + ", dag AS (SELECT src, dst FROM steps WHERE src < dst)"


def forward(spark, sf_dir):
    """All forward successions: src < dst alone leaves no cycles."""
    return steps(spark, sf_dir).filter("src < dst")


@query(f"WITH RECURSIVE {FORWARD}, walk AS (SELECT CAST(500 AS BIGINT) AS node, 0 AS depth UNION SELECT s.src, w.depth + 1 FROM walk w JOIN dag s ON s.dst = w.node WHERE w.depth < 6) SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def upstream_all(spark, sf_dir):
    edges = forward(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.closure(edges, spark.createDataFrame([(500,)], "node long"), 6)


@query(f"WITH {FORWARD}{TREE}")
def callers_tree_all(spark, sf_dir):
    return G.callers_tree(forward(spark, sf_dir), "300", 3)


@query(f"WITH {FORWARD}, nodes AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag) SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM dag)")
def roots_all(spark, sf_dir):
    edges = forward(spark, sf_dir)
    return G.roots(_nodes(edges), edges)


@query(f"WITH RECURSIVE {FORWARD}, nodes AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag), walk AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT dst FROM dag) UNION SELECT l.dst, w.level + 1 FROM walk w JOIN dag l ON l.src = w.node) SELECT node, max(level) AS level FROM walk GROUP BY node")
def topo_levels_all(spark, sf_dir):
    edges = cut(forward(spark, sf_dir))
    return G.topological_levels(_nodes(edges), edges)


@query(f"WITH RECURSIVE {FORWARD}, nodes AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag), walk AS (SELECT node, 0 AS depth FROM nodes WHERE node NOT IN (SELECT dst FROM dag) UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN dag l ON l.src = w.node) SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def depths_all(spark, sf_dir):
    edges = cut(forward(spark, sf_dir)).withColumn("label", F.lit(""))
    return G.tree_depths(_nodes(edges), edges)


@query(f"WITH RECURSIVE {FORWARD}, walk AS (SELECT CAST(20 AS BIGINT) AS node UNION SELECT l.dst FROM walk w JOIN dag l ON l.src = w.node) SELECT src, dst FROM dag WHERE src IN (SELECT node FROM walk) AND dst IN (SELECT node FROM walk)")
def subtree_all(spark, sf_dir):
    edges = cut(forward(spark, sf_dir))
    return G.extract_subtree(_nodes(edges), edges, 20)[1]


@query(f"WITH {FORWARD} SELECT src AS parent, dst AS node, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS BIGINT) AS place FROM dag")
def siblings_all(spark, sf_dir):
    found = G.siblings(forward(spark, sf_dir).withColumn("label", F.lit("")))
    return found.withColumn("place", F.col("place").cast("long"))


@query(f"WITH {FORWARD} SELECT src, dst FROM dag WHERE src % 5 <> 0 AND dst % 5 <> 0")
def delete_nodes_all(spark, sf_dir):
    edges = forward(spark, sf_dir)
    nodes = _nodes(edges)
    return G.delete_nodes(nodes, edges, nodes.filter("node % 5 = 0"))[1]


@query()
def is_descendant_all(spark, sf_dir):
    """Every pair of parts two lines apart in an order. DuckDB's walk from every part takes too long for SQL."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(by).alias("k"))
    later = items.select("l_orderkey", F.col("l_partkey").alias("node"), (F.col("k") - 2).alias("k"))
    pairs = items.withColumnRenamed("l_partkey", "ancestor").join(later, ["l_orderkey", "k"]).select("ancestor", "node").distinct()
    return G.is_descendant(cut(forward(spark, sf_dir)), pairs)


@query(f"WITH {FORWARD} SELECT src, dst FROM dag WHERE dst % 9 <> 4 UNION SELECT dst - 1, dst FROM (SELECT DISTINCT dst FROM dag WHERE dst % 9 = 4)")
def reparent_all(spark, sf_dir):
    """As reparent, over all forward successions."""
    edges = cut(forward(spark, sf_dir)).withColumn("label", F.lit(""))
    moves = edges.filter("dst % 9 = 4").select(F.col("dst").alias("node"), (F.col("dst") - 1).alias("parent")).distinct()
    return G.reparent(edges, moves)[0].select("src", "dst").distinct()


FACTS = ", facts AS (SELECT node, node % 5 <> 2 AS found, node % 5 = 3 AS macro, node % 5 = 4 AS other FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag))"


def _facts(edges):
    n = F.col("node") % 5
    return _nodes(edges).select("node", (n != 2).cast("int").alias("candidates"), (n == 3).alias("likely_macro"), (n == 4).alias("likely_non_callable"))


@query(f"""WITH {FORWARD}{FACTS}, open AS (SELECT d.src, d.dst, f.found FROM dag d JOIN facts f ON f.node = d.dst WHERE NOT (f.found AND (f.macro OR f.other))),
t1 AS (SELECT src AS parent, dst AS node, 1 AS depth, found FROM open WHERE src = 20), n1 AS (SELECT DISTINCT node FROM t1 WHERE found),
t2 AS (SELECT src AS parent, dst AS node, 2 AS depth, found FROM open WHERE src IN (SELECT node FROM n1)),
every AS (SELECT *, depth = 2 AND node IN (SELECT node FROM n1) AS old, row_number() OVER (PARTITION BY depth, node ORDER BY parent) AS k FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2))
SELECT parent, node, depth, CASE WHEN old OR k > 1 THEN 'already_visited' WHEN NOT found THEN 'no_definition' WHEN depth = 2 AND node IN (SELECT src FROM open) THEN 'depth_limit' END AS stop FROM every""")
def callees_tree(spark, sf_dir):
    """What part 20 leads to, two steps down, without macros and what can't be called."""
    edges = cut(forward(spark, sf_dir))
    return G.callees_tree(edges, "20", 2, _facts(edges))


@query(f"WITH {FORWARD}{FACTS} SELECT d.src AS node, count(*) FILTER (f.macro) AS macros, count(*) FILTER (f.other) AS non_callables FROM dag d JOIN facts f ON f.node = d.dst WHERE f.macro OR f.other GROUP BY d.src")
def excluded_callees(spark, sf_dir):
    edges = cut(forward(spark, sf_dir))
    return G.excluded_callees(edges, _facts(edges))


@query("SELECT 'o' || o_orderkey AS node, o_orderpriority || ':' || o_custkey AS label FROM orders UNION ALL SELECT 'edge:root>o' || o_orderkey, o_orderpriority || ':' || o_custkey FROM orders")
def expand_nodes(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("path"), F.col("o_custkey").alias("line_no"), F.col("o_orderstatus").alias("text"))
    nodes, edges = G.expand_nodes("root", hits)
    return nodes.select("node", "label").union(edges.select(F.concat(F.lit("edge:"), "src", F.lit(">"), "dst"), "label"))
