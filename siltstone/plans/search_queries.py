"""Search queries over the lines of documents."""

from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.functions import patterns as P
from siltstone.operators import search as S
from siltstone.operators.joins import dealt
from siltstone.plans.common import FILES, with_lines
from siltstone.plans.registry import query
from siltstone.sources import files as E
from siltstone.sources import table


def _files(spark, sf_dir):
    return S.document_files(table(spark, sf_dir, "documents"))


def _lines(spark, sf_dir):
    return S.explode_lines(_files(spark, sf_dir))


@query(with_lines("SELECT path, line_no, text FROM lines WHERE contains(lower(text), 'licensed under')"))
def search_literal(spark, sf_dir):
    return S.search(_lines(spark, sf_dir), "Licensed under")


@query(with_lines("SELECT path, line_no, text FROM lines WHERE regexp_matches(text, '(?i)licen[cs]e(d)?|public domain')"))
def search_regex(spark, sf_dir):
    return S.search(_lines(spark, sf_dir), "licen[cs]e(d)?|public domain", regex=True)


@query(with_lines(r"SELECT path, line_no, text FROM lines WHERE regexp_matches(text, '(?i)\bwork\b')"))
def search_word(spark, sf_dir):
    return S.search(_lines(spark, sf_dir), "work", word=True)


@query(with_lines("SELECT path, line_no, length(regexp_extract(text, '(?i)^(.*?)(work)', 1)) + 1 AS col, strlen(regexp_extract(text, '(?i)^(.*?)(work)', 1)) + 1 AS byte_col, substr(sha1(path || ':' || line_no || ':' || (length(regexp_extract(text, '(?i)^(.*?)(work)', 1)) + 1)), 1, 16) AS id FROM lines WHERE contains(lower(text), 'work')"))
def search_ids(spark, sf_dir):
    return S.hit_columns(S.search(_lines(spark, sf_dir), "work"), "work").select("path", "line_no", F.col("col").cast("long").alias("col"), F.col("byte_col").cast("long").alias("byte_col"), "id")


@query(with_lines("SELECT path, line_no, text, p AS pattern FROM lines, (VALUES ('license'), ('version'), ('idiot'), ('all rights')) v(p) WHERE contains(lower(text), p)"))
def search_many(spark, sf_dir):
    return S.search_many(_lines(spark, sf_dir), ["license", "version", "idiot", "all rights"])


PATTERNS = r"""words AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark), patterns AS (SELECT DISTINCT array_to_string(w[i:i + 3], ' ') AS pattern FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM words) UNION SELECT w[1] FROM words WHERE len(w) > 0)"""


@query(with_lines("SELECT path, line_no, text, pattern FROM lines JOIN patterns ON contains(lower(text), lower(pattern))", PATTERNS))
def search_table(spark, sf_dir):
    """Every four words in a row of the benchmark's items, and their first words, in all lines."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    runs = words.filter("size(w) > 3").select(F.explode(F.expr("transform(sequence(1, size(w) - 3), i -> array_join(slice(w, i, 4), ' '))")).alias("pattern"))
    return S.search_table(_lines(spark, sf_dir), runs.union(words.filter("size(w) > 0").select(F.col("w")[0])))


@query(f"WITH {FILES} SELECT path, length(regexp_extract(content, '^([^\\n]*\\n)', 1)) AS first_break, len(string_split(content, '.' || chr(10))) - 1 AS n_matches FROM files WHERE contains(content, '.' || chr(10))")
def search_multiline_counts(spark, sf_dir):
    """Sentence ends at line ends, by file."""
    files = _files(spark, sf_dir)
    counts = S.search_multiline(files, r"\.\n").groupBy("path").agg(F.count("*").alias("n_matches"))
    return counts.join(files.select("path", F.length(F.regexp_extract("content", r"^([^\n]*\n)", 1)).alias("first_break")), "path")


@query(with_lines("SELECT path, line_no FROM lines WHERE contains(text, '.') AND line_no < (SELECT max(line_no) FROM lines l WHERE l.path = lines.path) AND ends_with(text, '!')"))
def search_multiline(spark, sf_dir):
    """A mark of exclamation at the end of a line with another line behind it."""
    hits = S.search_multiline(_files(spark, sf_dir), r"!\n")
    return hits.join(_lines(spark, sf_dir).filter(F.col("text").contains(".")).select("path", "line_no"), ["path", "line_no"], "left_semi").select("path", "line_no")


@query(with_lines("SELECT path, line_no, text FROM lines WHERE contains(lower(text), 'the') AND ((contains(lower(path || ' ' || text), 'license') AND NOT contains(lower(path || ' ' || text), 'gnu')) OR contains(lower(string_split(path, '/')[-1]), '7.txt') OR contains(lower(path), 'src3/en'))"))
def refine_and_or_not(spark, sf_dir):
    return S.refine(S.search(_lines(spark, sf_dir), "the"), "license -gnu | file:7.txt | path:src3/en")


@query(with_lines("SELECT path, line_no, text FROM lines WHERE contains(lower(text), 'of') AND contains(lower(path), 'en') AND NOT contains(lower(path || ' ' || text), 'version')"))
def refine_refs(spark, sf_dir):
    return S.refine_refs(S.search(_lines(spark, sf_dir), "of"), "path:en -version")


@query(f"WITH {FILES} SELECT path FROM files WHERE (regexp_matches(lower(string_split(path, '/')[-1]), '^1[^/]*\\.txt$') OR contains(lower(path), 'src2/de')) AND ends_with(lower(string_split(path, '/')[-1]), '.txt') AND NOT regexp_matches(lower(path), '^src1/.*$')")
def path_filter(spark, sf_dir):
    return _files(spark, sf_dir).filter(P.path_condition("1*.txt|src2/de .txt -src1/**")).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(string_split(path, '/')[-1], '^[^/][^/]\\.txt$') OR regexp_matches(string_split(path, '/')[-1], '^9[^/]*$')")
def include_globs(spark, sf_dir):
    return _files(spark, sf_dir).filter(P.include_condition("any/??.txt, 9*")).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE starts_with(lower(path), 'src5/fr/')")
def scope_dir(spark, sf_dir):
    return _files(spark, sf_dir).filter(C.under("path", "SRC5/fr/")).select("path")


RULES = "# comment\n/src1/\n*7.txt\n!src2/**/*7.txt\nde/\n!src3/de/3.txt\nsrc4/en/*\n!src4/en/24*.txt\n*[2-3]?.t[xy]t\n!fr/**\nsrc5/*/\\1[^01]*\nsrc*/it/**/x\n[.txt\n"


@query(f"""WITH {FILES}, parts AS (SELECT path, string_split(path, '/') AS p FROM files)
SELECT path FROM parts WHERE NOT (p[1] = 'src1' OR p[2] = 'de'
  OR (CASE WHEN p[1] = 'src5' AND regexp_matches(p[3], '^1[2-9.]') THEN true WHEN regexp_matches(p[3], '[23].\\.txt$') THEN true
      WHEN p[1] = 'src4' AND p[2] = 'en' AND starts_with(p[3], '24') THEN false WHEN p[1] = 'src4' AND p[2] = 'en' THEN true
      WHEN p[1] = 'src2' AND ends_with(p[3], '7.txt') THEN false WHEN ends_with(p[3], '7.txt') THEN true ELSE false END))""")
def gitignore_exclude(spark, sf_dir):
    return S.exclude(_files(spark, sf_dir), RULES).select("path")


@query(with_lines("SELECT h.path, h.line_no, string_agg(l.line_no || ':' || (l.line_no = h.line_no) || ':' || length(l.text), '|' ORDER BY l.line_no) AS snippet FROM (SELECT * FROM lines WHERE contains(lower(text), 'licensed')) h JOIN lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY h.path, h.line_no"))
def snippets(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    found = S.snippets(S.search(lines, "licensed"), lines, 2)
    return found.select("path", "line_no", F.array_join(F.transform("snippet", lambda s: F.concat_ws(":", s["line"].cast("string"), s["is_match"].cast("string"), F.length(s["text"]).cast("string"))), "|").alias("snippet"))


@query(with_lines("SELECT path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM lines WHERE contains(lower(text), 'the')) WHERE n <= 3"))
def max_per_file(spark, sf_dir):
    return S.max_per_file(S.search(_lines(spark, sf_dir), "the"), 3).select("path", "line_no")


@query(with_lines("SELECT path, line_no, true AS has_more, 30 AS next_offset FROM lines WHERE contains(lower(text), 'the') ORDER BY path, line_no LIMIT 20 OFFSET 10"))
def page_has_more(spark, sf_dir):
    return S.page(S.search(_lines(spark, sf_dir), "the").select("path", "line_no"), ["path", "line_no"], 10, 20)


@query(with_lines("SELECT path, line_no, (SELECT count(*) FROM lines WHERE contains(lower(text), 'version')) > 5 AS truncated FROM lines WHERE contains(lower(text), 'version') ORDER BY path, line_no LIMIT 5"))
def cap_truncated(spark, sf_dir):
    return S.cap(S.search(_lines(spark, sf_dir), "version").select("path", "line_no"), ["path", "line_no"], 5)


@query(with_lines("SELECT src AS path, lang AS func, count(*) AS n_hits, grouping(src, lang) AS level FROM (SELECT string_split(path, '/')[1] AS src, string_split(path, '/')[2] AS lang FROM lines WHERE contains(lower(text), 'the')) GROUP BY ROLLUP (src, lang)"))
def hits_by_group(spark, sf_dir):
    parts = F.split("path", "/")
    hits = S.search(_lines(spark, sf_dir), "the").select(F.get(parts, 0).alias("p"), F.get(parts, 1).alias("func")).withColumnRenamed("p", "path")
    return S.hits_by_function(hits)


@query(f"WITH {FILES} SELECT count(*) AS files_matched, CASE WHEN count(*) = 0 THEN 'no_file_matches_glob' ELSE 'looks_like_regex' END AS reason FROM files WHERE regexp_matches(string_split(path, '/')[-1], '^[^/]*\\.txt$')")
def zero_hit_reason(spark, sf_dir):
    return S.zero_hit_reason(_files(spark, sf_dir), r"licen.*\b", "*.txt")


@query(f"WITH {FILES} SELECT DISTINCT d AS dir FROM (SELECT unnest([string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS d FROM files)")
def list_dirs(spark, sf_dir):
    return S.list_dirs(_files(spark, sf_dir))


@query(with_lines(r"SELECT DISTINCT path, name FROM (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM lines) WHERE name IN ('license', 'version', 'work', 'idiot')"))
def known_tokens(spark, sf_dir):
    names = spark.createDataFrame([("license",), ("version",), ("work",), ("idiot",)], "name string")
    lines = _lines(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    return S.tokens_in_file(lines, names)


@query("SELECT DISTINCT name FROM (SELECT p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'define' ELSE 'func' END AS kind FROM part) WHERE kind = 'define' AND regexp_matches(name, '^[A-Za-z_]') AND regexp_matches(name, '[A-Z]')")
def macro_style_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return S.macro_names(part.select(F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, "define").otherwise("func").alias("kind")))


#: Lines of source made of a part's name, and the kind that each defines.
KINDS = [
    ("#define N 100", "define"), ("# define N(x) ((x) + 1)", "define"), ("\t#define N(a)", "define"), ("#defineN(a)", "func"), ("} N;", "typedef_close"), ("} my_enum_N;", "typedef_close"),
    ("static struct s *N(int a)", "func"), ("int N(struct s *p) {", "func"), ("struct N { int (*f)(void); };", "struct"), ("mystruct_t N;", "struct"), ("typedef enum N", "enum"), ("union N {", "union"),
    ("    N,", "enum_member"), ("\tN = 3,", "enum_member"), ("N", "enum_member"), ("N = 3,", "enum_member"), ("N = a + 1 ,", "enum_member"), ("N = {1},", "func"), ("int N;", "func"), ("int N", "func"),
]


@query("SELECT p_partkey, v.kind FROM part JOIN (VALUES " + ", ".join(f"({i}, '{kind}')" for i, (_, kind) in enumerate(KINDS)) + f") v(form, kind) ON v.form = p_partkey % {len(KINDS)}")
def classify_line(spark, sf_dir):
    line = F.replace(F.get(F.array(*[F.lit(text) for text, _ in KINDS]), (F.col("p_partkey") % len(KINDS)).cast("int")), F.lit("N"), F.concat(F.lit("N"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", S.classify_line(line).alias("kind"))


@query(r"""SELECT event_id, regexp_matches(line, '\bk\b\s*(?:=(?:[^=]|$)|[-+*/%&|^]=|<<=|>>=|\+\+|--)') AS is_assign,
  CASE WHEN event_id % 3 = 0 THEN '+= ' || event_type WHEN event_id % 3 = 1 THEN event_type END AS value
FROM (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'k += ' || event_type || '; done' WHEN 1 THEN '  k = ' || event_type || ' ;' ELSE 'if (k == ' || event_type || ')' END AS line FROM events)""")
def assigned_value(spark, sf_dir):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k += "), "event_type", F.lit("; done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  k = "), "event_type", F.lit(" ;"))).otherwise(F.concat(F.lit("if (k == "), "event_type", F.lit(")")))
    events = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return events.select("event_id", S.is_assignment(F.col("line"), "k").alias("is_assign"), S.assigned_value(F.col("line"), "k").alias("value"))


@query(with_lines("SELECT path, line_no, CASE WHEN length(trim(text)) > 200 THEN substr(trim(text), 1, 200) || '…' ELSE trim(text) END AS site FROM lines"))
def site_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("path", "line_no", S.site_text(F.col("text")).alias("site"))


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT starts_with(lower(path), 'src1/')")
def foreign_rows(spark, sf_dir):
    return S.foreign_rows(_files(spark, sf_dir), "SRC1\\").select("path")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)a.*e') AND contains(lower(p_brand), 'brand#1')")
def name_pattern(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "path")
    return part.filter(P.name_condition("a e path:brand#1", name="p_name")).select("p_partkey", "p_name")


@query("""SELECT name, path, line_no, kind, rank, true AS truncated FROM (SELECT p_name AS name, p_brand AS path, CAST(p_partkey AS INT) AS line_no, kind, CASE WHEN lower(p_name) = 'e' THEN -1 WHEN kind = 'func' THEN 0 WHEN kind = 'define' THEN 1 WHEN kind = 'typedef' THEN 2 ELSE 3 END AS rank
  FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'func' WHEN 1 THEN 'define' WHEN 2 THEN 'typedef' ELSE 'struct' END AS kind FROM part) WHERE regexp_matches(p_name, '(?i)e') AND NOT contains(lower(p_brand), 'brand#2'))
ORDER BY rank, name, path, line_no LIMIT 50""")
def symbol_search(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("func", "define", "typedef", "struct"))), F.col("p_size") % 4 + 1)
    symbols = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_partkey").cast("int").alias("line_no"), kinds.alias("kind"))
    return S.symbol_search(symbols, "e", None, "-brand#2", 50)


@query("""SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY kind <> 'func', path) AS new_pos FROM (SELECT p_type AS name, p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'func' ELSE 'define' END AS kind FROM part)""")
def rank_by_tag(spark, sf_dir):
    defs = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("path"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 2 == 0, "func").otherwise("define").alias("kind"))
    return S.rank_by_tag(defs, "func").select("name", "path", F.col("new_pos").cast("long").alias("new_pos"))


@query("""SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY p_size % 6 >= 3, path) AS new_pos FROM (SELECT p_type AS name, p_size, p_partkey || ['.c', '.cxx', '.java', '.txt', '.html', '.go'][p_size % 6 + 1] AS path FROM part)""")
def demote_non_source(spark, sf_dir):
    path = F.concat(F.col("p_partkey").cast("string"), F.get(F.array(*map(F.lit, (".c", ".cxx", ".java", ".txt", ".html", ".go"))), F.col("p_size") % 6))
    defs = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), path.alias("path")).withColumn("pos", F.col("path"))
    return S.demote_non_source(defs).select("name", "path", F.col("new_pos").cast("long").alias("new_pos"))


@query(with_lines("SELECT path, line_no, NOT regexp_matches(text, '\\bof\\s*\\(') AS indirect FROM lines WHERE regexp_matches(text, '\\bof\\b')"))
def mark_indirect(spark, sf_dir):
    hits = S.search(_lines(spark, sf_dir), "of", case=True, word=True)
    return hits.select("path", "line_no", S.is_indirect(F.col("text"), "of").alias("indirect"))


@query("SELECT user_id, max(CASE WHEN event_id % 2 = 0 THEN 1 ELSE event_id END) AS a, max(1) AS b FROM events GROUP BY user_id")
def parse_defines(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.lit("A=x B")).otherwise(F.concat(F.lit("A="), F.col("event_id").cast("string"), F.lit(" B")))
    return table(spark, sf_dir, "events").select("user_id", P.parse_defines(text).alias("m")).groupBy("user_id").agg(F.max(F.col("m")["A"]).cast("long").alias("a"), F.max(F.col("m")["B"]).alias("b"))


@query(f"""WITH {FILES}, hits AS (SELECT source, lang, path, line_no, text, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM (
  SELECT source, lang, source || '/' || lang || '/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE source <> 'src1')
  WHERE regexp_matches(text, '(?i)license'))
SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS grp, count(*) AS n_hits, count(DISTINCT path) AS n_files FROM hits WHERE n <= 5 GROUP BY grp""")
def license_slice(spark, sf_dir):
    """The minimum slice: search, exclusion, cap per file and counts by source and language."""
    kept = S.exclude(_files(spark, sf_dir), "/src1/\n")
    hits = S.max_per_file(S.search(S.explode_lines(kept), "license", regex=True), 5)
    return hits.groupBy(C.path_dir("path").alias("grp")).agg(F.count("*").alias("n_hits"), F.count_distinct("path").alias("n_files"))


@query(with_lines("SELECT path, line_no, text FROM lines WHERE contains(lower(text), 'license')"))
def search_encoded(spark, sf_dir):
    """Documents kept as UTF-16 and read so."""
    files = _files(spark, sf_dir).select("path", F.encode("content", "UTF-16LE").alias("content"))
    return E.search_encoded(files, "utf-16le", "license")


@query("SELECT p_partkey, CASE letter WHEN 'f' THEN 'func' WHEN 's' THEN 'struct' WHEN 'u' THEN 'union' WHEN 'e' THEN 'enum_member' WHEN 'g' THEN 'enum' WHEN 'd' THEN 'define' WHEN 't' THEN 'typedef' WHEN 'm' THEN 'member' WHEN 'v' THEN 'var' ELSE letter END AS kind FROM (SELECT p_partkey, chr(CAST(97 + p_partkey % 26 AS INT)) AS letter FROM part)")
def tag_kinds(spark, sf_dir):
    letter = F.chr(97 + F.col("p_partkey") % 26)
    return table(spark, sf_dir, "part").select("p_partkey", E.tag_kind(letter).alias("kind"))


@query("SELECT p_partkey, regexp_matches(p_name, '^a') OR contains(p_brand, '#1') AS trivial, p_size % 4 NOT IN (2, 3) AS callable FROM part")
def flag_trivial(spark, sf_dir):
    kinds = F.get(F.array(F.lit("func"), F.lit(None), F.lit("typedef"), F.lit("struct")), F.col("p_size") % 4)
    symbols = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("path"), kinds.alias("kind"))
    return S.flag_trivial(symbols, ["^a"], ["#1"]).select("p_partkey", "trivial", "callable")


#: Every part's key written in C's ways, and its places.
@query("""SELECT p_partkey, p_partkey AS dec, p_partkey AS hex, p_partkey AS oct, p_partkey AS bin, CAST(NULL AS BIGINT) AS bad, lower(to_hex(p_partkey)) AS as_hex, bin(p_partkey) AS as_bin,
  array_to_string(list_filter(range(0, 40), lambda i: (p_partkey >> i) & 1 = 1), ',') AS bits,
  'g(1, [2, 3])' AS arg, 'part_' AS prefix, 'C:/a::b' AS key_path, CAST(p_partkey AS INT) AS key_line, 'x = ' || p_partkey || '; ' AS code, 1 AS balance, p_partkey % 2 = 0 AS has_word FROM part""")
def scalar_functions(spark, sf_dir):
    k = F.col("p_partkey")
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", k.cast("string").alias("s")), "p_partkey")
    forms, text = C.radix_forms("p_partkey"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    low, high = text("part_a", F.col("s")), text("part_b", F.col("s"))
    key = C.split_line_key(text("C:/a::b::", F.col("s")))
    return part.select(
        "p_partkey", C.parse_int_literal("s").alias("dec"), C.parse_int_literal(text("0x", F.hex(k), "UL")).alias("hex"), C.parse_int_literal(text("0", F.conv("s", 10, 8))).alias("oct"),
        C.parse_int_literal(text("0b", F.bin(k))).alias("bin"), C.parse_int_literal(text(F.col("s"), "+1")).alias("bad"), forms["hex"].alias("as_hex"), forms["bin"].alias("as_bin"),
        F.array_join(F.transform(C.set_bits(k), lambda i: i.cast("string")), ",").alias("bits"), C.nth_arg(text("f(a, b), g(1, [2, 3]), ", F.col("s")), 1).alias("arg"), C.common_prefix(low, high).alias("prefix"),
        key["path"].alias("key_path"), key["line_no"].alias("key_line"), C.strip_line_comment(text("x = ", F.col("s"), "; // y")).alias("code"), C.brace_balance(F.lit("{ { }")).alias("balance"),
        C.contains_word(F.when(k % 2 == 0, "a word_b word;").otherwise("a word_b words;"), "word").alias("has_word"),
    )


@query()
def fuzzy_paths(spark, sf_dir):
    """The 50 paths that fit two loose words best; tests hold the score against brute force."""
    return S.fuzzy_rank(_files(spark, sf_dir).select("path"), "web 1", 50)
