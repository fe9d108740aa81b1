"""The reference map over parts as files and order lines as references."""

from pyspark.sql import functions as F

from siltstone.operators import refmap as R
from siltstone.plans.registry import query
from siltstone.sources import table

SYMS = """syms AS (SELECT p_partkey, p_brand || '|' || p_type || '|' || p_size AS name, p_brand || '/' || p_type || '/part_' || p_partkey AS path, p_size % 10 = 0 AS is_static, p_size < 3 AS is_header FROM part),
refs AS (SELECT DISTINCT a.path AS src, a.is_header, b.name FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem) l JOIN syms a ON a.p_partkey = l.l_partkey JOIN syms b ON b.p_partkey = l.nxt),
impl AS (SELECT * FROM syms WHERE NOT is_header), facts AS (SELECT name, count(DISTINCT path) AS n, min(path) AS file, bool_and(is_static) AS static FROM impl GROUP BY name),
resolved AS (SELECT src, name, CASE verdict WHEN 'edge' THEN file WHEN 'self' THEN src END AS def, verdict FROM (
  SELECT r.src, r.name, f.file, CASE WHEN r.is_header THEN 'header' WHEN EXISTS (SELECT 1 FROM impl s WHERE s.name = r.name AND s.path = r.src) THEN 'self' WHEN f.static THEN 'static' WHEN f.n = 1 THEN 'edge' ELSE 'ambiguous' END AS verdict
  FROM refs r LEFT JOIN facts f ON f.name = r.name WHERE r.is_header OR f.name IS NOT NULL))"""
EDGES = SYMS + ", edges AS (SELECT src, def, count(DISTINCT name) AS count, list_sort(list(DISTINCT name)) AS syms FROM resolved WHERE verdict = 'edge' GROUP BY src, def)"


def _fold(src: str, dst: str, more: str = "", source: str = "edges") -> str:
    return f"""SELECT {more}"from", "to", CAST(sum(count) AS BIGINT) AS count, array_to_string(list_slice(list_sort(list_distinct(flatten(list(syms)))), 1, 8), ',') AS syms, len(list_distinct(flatten(list(syms)))) > 8 AS capped
FROM (SELECT *, {src} AS "from", {dst} AS "to" FROM {source}) WHERE "from" <> "to" GROUP BY {more}"from", "to\""""


def prefix(path: str, depth: int) -> str:
    return f"CASE WHEN len(string_split({path}, '/')) - 1 < {depth} THEN {path} ELSE array_to_string(string_split({path}, '/')[1:{depth}], '/') END"


def _symbols(spark, sf_dir):
    return R.part_files(table(spark, sf_dir, "part"))


def resolved(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return R.resolve_refs(R.part_refs(table(spark, sf_dir, "lineitem"), symbols), symbols)


def edges(spark, sf_dir):
    return R.file_edges(resolved(spark, sf_dir))


def _shown(df):
    return df.withColumn("syms", F.array_join("syms", ","))


@query(f"WITH {SYMS} SELECT src, name, def, verdict FROM resolved")
def resolve_refs(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(f"WITH {SYMS} SELECT (SELECT count(*) FROM facts WHERE n > 1) AS same_name_symbols, count(*) FILTER (verdict = 'ambiguous') AS same_name_refs, count(*) FILTER (verdict = 'static') AS static_refs, count(*) FILTER (verdict = 'header') AS header_refs FROM resolved")
def omitted_refs(spark, sf_dir):
    return R.omitted(resolved(spark, sf_dir), _symbols(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, def, count, array_to_string(syms, ',') AS syms FROM edges")
def file_edges(spark, sf_dir):
    return _shown(edges(spark, sf_dir))


@query(f"WITH {EDGES} " + _fold(prefix("src", 1), prefix("def", 1)))
def overview_depth1(spark, sf_dir):
    return _shown(R.overview(edges(spark, sf_dir), 1))


@query(f"WITH {EDGES} " + _fold(prefix("src", 2), prefix("def", 2)))
def overview_depth2(spark, sf_dir):
    return _shown(R.overview(edges(spark, sf_dir), 2))


@query()
def overview_auto(spark, sf_dir):
    """Adaptive groups, then the fold by them; the fold's sum and the self references make the total."""
    e = edges(spark, sf_dir)
    return _shown(R.overview_auto(e, R.adaptive_groups(e)))


@query(f"WITH {EDGES}, faced AS (SELECT *, starts_with(src, 'Brand#11/') AS i, starts_with(def, 'Brand#11/') AS o FROM edges WHERE starts_with(src, 'Brand#11/') OR starts_with(def, 'Brand#11/')), named AS (SELECT *, CASE WHEN i AND o THEN 'internal' WHEN o THEN 'incoming' ELSE 'outgoing' END AS face FROM faced) " + _fold(f"CASE WHEN i THEN {prefix('src', 2)} ELSE {prefix('src', 1)} END", f"CASE WHEN o THEN {prefix('def', 2)} ELSE {prefix('def', 1)} END", "face, ", "named"))
def focus_faces(spark, sf_dir):
    return _shown(R.focus(edges(spark, sf_dir), "Brand#11"))


@query(f"WITH {EDGES} SELECT DISTINCT unnest(syms) AS name FROM edges WHERE starts_with(src, 'Brand#11/') AND starts_with(def, 'Brand#12/')")
def edge_symbols(spark, sf_dir):
    return R.edge_symbols(edges(spark, sf_dir), "Brand#11", "Brand#12")


@query(f"""WITH {EDGES}, held AS (SELECT {prefix('path', 2)} AS child, count(DISTINCT path) AS n_files FROM syms WHERE starts_with(path, 'Brand#11/') GROUP BY 1),
inward AS (SELECT {prefix('def', 2)} AS child, sum(count) AS incoming FROM edges WHERE starts_with(def, 'Brand#11/') AND NOT starts_with(src, {prefix('def', 2)} || '/') GROUP BY 1)
SELECT h.child AS path, n_files, false AS is_file, CAST(coalesce(incoming, 0) AS BIGINT) AS incoming FROM held h LEFT JOIN inward i ON i.child = h.child""")
def children(spark, sf_dir):
    return R.children(edges(spark, sf_dir), _symbols(spark, sf_dir), "Brand#11")


@query(f"WITH {EDGES} SELECT path, CAST(sum(count) AS BIGINT) AS weight FROM (SELECT src AS path, count FROM edges UNION ALL SELECT def, count FROM edges) GROUP BY path")
def file_weights(spark, sf_dir):
    return R.file_weights(edges(spark, sf_dir))


@query(f"WITH {EDGES}, folded AS ({_fold(prefix('src', 2), prefix('def', 2))}) SELECT \"from\" || '>' || \"to\" || ':' || count AS line, (SELECT count(*) FROM folded) AS total_edges, (SELECT CAST(sum(count) AS BIGINT) FROM folded) AS total_count FROM folded ORDER BY count DESC, \"from\", \"to\" LIMIT 40")
def brief_edges(spark, sf_dir):
    return R.brief(R.overview(edges(spark, sf_dir), 2))


@query(f"""WITH {EDGES}, opened AS (SELECT {prefix('def', 1)} AS module, count(DISTINCT def) AS files_open FROM edges WHERE {prefix('src', 1)} <> {prefix('def', 1)} GROUP BY 1)
SELECT m.module, coalesce(files_open, 0) AS files_open, m.files FROM (SELECT {prefix('path', 1)} AS module, count(DISTINCT path) AS files FROM syms GROUP BY 1) m LEFT JOIN opened o ON o.module = m.module""")
def public_surface(spark, sf_dir):
    return R.public_surface(edges(spark, sf_dir), _symbols(spark, sf_dir))


@query(f"WITH {EDGES}, folded AS ({_fold(prefix('src', 1), prefix('def', 1))}) SELECT * FROM folded ORDER BY count DESC, \"from\", \"to\" LIMIT 10")
def top_edges(spark, sf_dir):
    return _shown(R.top_edges(R.overview(edges(spark, sf_dir), 1), 10))
