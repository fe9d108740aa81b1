"""Text search over lines: hits, filters, context, paging, ranking."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import patterns as P
from siltstone.functions.columns import hit_id, path_dir, path_ext, path_prefixes, quoted, trimmed
from siltstone.operators.joins import merged
from siltstone.sources.scratch import written

SITE_LENGTH = 200
#: Letters of patterns to an automaton.
MOST_LETTERS = 1 << 24
#: Extensions of source files.
SOURCE_FILES = (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".java")


def files_from_table(df: DataFrame, path: Column, text: str) -> DataFrame:
    """(path, content) of a keyed text table."""
    return df.select(path.alias("path"), F.col(text).alias("content"))


def document_files(documents: DataFrame) -> DataFrame:
    return files_from_table(documents, F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), "text")


def explode_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text), lines numbered from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def search(lines: DataFrame, pattern: str, regex: bool = False, case: bool = False, word: bool = False) -> DataFrame:
    return lines.filter(P.search_condition("text", pattern, regex, case, word))


def search_multiline(files: DataFrame, regex: str) -> DataFrame:
    """(path, line_no, match): non-overlapping matches of a pattern that may cross lines."""
    # from where the match before ended, or one further where that was empty: else what is behind the last match is read again from each of its places
    at = f"(?:\\G|(?<=\\G[\\s\\S]))([\\s\\S]*?)({regex})"
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(at), F.lit(1)).alias("skip"), F.regexp_extract_all("content", F.lit(at), F.lit(2)).alias("match"))
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    found = files.filter(F.col("content").rlike(regex)).select("path", F.posexplode(pairs).alias("k", "m"))
    run = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(breaks(F.col("m.skip")) + breaks(F.col("m.match"))).over(run), F.lit(0))
    return found.select("path", (before + breaks(F.col("m.skip")) + 1).cast("int").alias("line_no"), F.col("m.match").alias("match"))


def hit_columns(hits: DataFrame, pattern: str, regex: bool = False, case: bool = False) -> DataFrame:
    """hits with col (characters from 1), byte_col and the stable id."""
    body = pattern if regex else quoted(pattern)
    at = F.regexp_instr("text", F.lit(body if case else f"(?i){body}"))
    hits = hits.withColumn("col", at)
    return hits.withColumn("byte_col", F.octet_length(F.expr("substring(text, 1, col - 1)")) + 1).withColumn("id", hit_id("path", "line_no", "col"))


def search_many(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, line_no, text, pattern) of many literals in one pass, regardless of case: one alternation first, then which."""
    any_hit = lines.filter(F.col("text").rlike("(?i)" + "|".join(map(quoted, patterns))))
    found = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower("text"), F.lower(p)))
    return any_hit.select("path", "line_no", "text", F.explode(found).alias("pattern"))


def search_table(lines: DataFrame, patterns: DataFrame, most: int = MOST_LETTERS) -> DataFrame:
    """(path, line_no, text, pattern): every literal of patterns(pattern) that a line holds, regardless of case.

    One automaton of all patterns reads each line once, however many there are. The patterns are measured
    first: up to `most` letters go to the tasks as one broadcast; more are dealt by hash to as many
    automata as it takes, each with a pass of its own. Null patterns match nothing, an empty one every
    line with a text; a pattern that is listed twice counts once.
    """
    wanted = patterns.select("pattern").filter("pattern IS NOT NULL").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.char_length("pattern")), F.lit(0))).first()[0]
    shards = -(-size // most) or 1
    lowered = lines.select("path", "line_no", "text", F.lower("text").alias("_low"))
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    out = ", ".join(f"{c} {kinds[c]}" for c in ("path", "line_no", "text")) + ", pattern string"
    found = None
    for shard in range(shards):
        rows = wanted.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard).select("pattern", F.lower("pattern")).collect()  # about `most` letters
        words = lines.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches, words=words):
            machine, plain = Automaton(words.value), None
            for batch in batches:
                plain = plain or batch.schema.field("text").type
                at, hits = machine.find(batch.column("_low").to_pylist())
                kept = batch.select(["path", "line_no", "text"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hits, pa.string())], names=[*kept.schema.names, "pattern"])

        part = lowered.mapInArrow(run, out)
        found = part if found is None else found.unionByName(part)
    return found


class Automaton:
    """Literals, lowered, as one Aho-Corasick automaton; patterns that are equal when lowered are found together."""

    def __init__(self, patterns: list[tuple[str, str]]):
        self.always, by = [], {}
        for pattern, low in patterns:
            (by.setdefault(low, []) if low else self.always).append(pattern)
        self.machine = ahocorasick.Automaton()
        for low, same in by.items():
            self.machine.add_word(low, same)
        if by:
            self.machine.make_automaton()
        self.any = bool(by)

    def find(self, texts: list[str | None]) -> tuple[list[int], list[str]]:
        """(places in texts, patterns found there), each pattern once for a text."""
        at, hits = [], []
        for i, text in enumerate(texts):
            if text is not None:
                found = dict.fromkeys(self.always)
                for _, same in self.machine.iter(text) if self.any else ():
                    found.update(dict.fromkeys(same))
                at += [i] * len(found)
                hits += found
        return at, hits


def refine(hits: DataFrame, expr: str) -> DataFrame:
    return hits.filter(P.refine_condition(expr))


def refine_refs(refs: DataFrame, expr: str, func: str | None = None) -> DataFrame:
    return refs.filter(P.refine_refs_condition(expr, func=func))


def exclude(df: DataFrame, rules: str) -> DataFrame:
    """df without the rows of excluded files: one condition on the path, no join; a file in an excluded folder can't be taken back."""
    return df.filter(~P.excluded("path", rules))


def code_hits(hits: DataFrame, code_lines: DataFrame, word: str) -> DataFrame:
    """Hits whose word stands in the line's code; code_lines(path, line_no, code)."""
    return merged(hits, code_lines.filter(F.col("code").contains(word)).select("path", "line_no"), ["path", "line_no"], "left_semi")


def classify_line(text) -> Column:
    """The kind of symbol that one line of source defines; the order of the tests matters."""
    t = trimmed(text)
    brace, paren = F.instr(t, "{"), F.instr(t, "(")
    call = (paren > 0) & ((brace == 0) | (paren < brace))
    return (
        F.when(t.rlike(r"^#\s*define\s+\w"), "define").when(t.startswith("}"), "typedef_close").when(call, "func")
        .when(t.contains("struct"), "struct").when(t.contains("enum"), "enum").when(t.contains("union"), "union")
        .when(text.rlike(r"^[ \t]"), "enum_member").when(t.rlike(r"^[A-Za-z_]\w*(\s*=\s*[^,{}();]+)?\s*,?\s*$"), "enum_member").otherwise("func")
    )


def classify_hit(hits: DataFrame, lines: DataFrame, ahead: int = 6) -> DataFrame:
    """hits with kind, by the line and up to `ahead` lines after it: a header that ends in `;` before any `{` declares, an open one that meets `{` defines."""
    run = Window.partitionBy("path").orderBy("line_no").rowsBetween(1, ahead)
    near = lines.withColumn("after", F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text")).over(run)), lambda s: s["text"]), "\n"))
    joined = merged(hits, near.select("path", "line_no", "after"), ["path", "line_no"], "left")
    both = F.concat_ws("\n", F.col("text"), F.col("after"))
    brace, end = F.instr(both, "{"), F.instr(both, ";")
    kind = classify_line(F.col("text"))
    func = F.when((end > 0) & ((brace == 0) | (end < brace)), "declaration").when(brace > 0, "func").otherwise("declaration")
    return joined.withColumn("kind", F.when(kind == "func", func).otherwise(kind)).drop("after")


def is_assignment(text, word: str) -> Column:
    """w =, w op=, w++, w--, ++w, --w; never ==, and not ++w->x."""
    w = quoted(word)
    return text.rlike(rf"\b{w}\b\s*(?:=(?:[^=]|$)|[-+*/%&|^]=|<<=|>>=|\+\+|--)") | text.rlike(rf"(?:\+\+|--)\s*{w}\b\s*(?:[^-.\[\w\s]|-[^>]|$)")


def assigned_value(text, word: str) -> Column:
    """The right side up to `;`, with a compound operator before it."""
    w = quoted(word)
    at = rf"\b{w}\b\s*((?:[-+*/%&|^]|<<|>>)?)=([^=;][^;]*)"
    sign, value = F.regexp_extract(text, at, 1), F.trim(F.regexp_extract(text, at, 2))
    return F.when(value == "", None).when(sign != "", F.concat(sign, F.lit("= "), value)).otherwise(value)


def is_indirect(text, word: str) -> Column:
    """A mention that isn't a call."""
    return ~text.rlike(rf"\b{quoted(word)}\s*\(")


def site_text(text) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > SITE_LENGTH, F.concat(F.substring(t, 1, SITE_LENGTH), F.lit("…"))).otherwise(t)


def flag_trivial(symbols: DataFrame, names: list[str], paths: list[str], kinds: tuple = ("define", "enum_member", "struct", "union", "enum", "typedef")) -> DataFrame:
    """symbols with trivial (name or path matches a list of patterns) and callable (by kind; an unknown kind may be called)."""
    trivial = P.any_of([F.col("name").rlike(n) for n in names] + [F.col("path").rlike(p) for p in paths])
    return symbols.withColumn("trivial", trivial).withColumn("callable", F.coalesce(~F.col("kind").isin(*kinds), F.lit(True)))


def zero_hit_reason(files: DataFrame, pattern: str, globs: str) -> DataFrame:
    """One row (files_matched, reason): why a literal search may have found nothing."""
    n = files.filter(P.include_condition(globs)).agg(F.count("*").alias("files_matched"))
    looks = F.lit(P.zero_hit_looks_like_regex(pattern))
    return n.withColumn("reason", F.when(F.col("files_matched") == 0, "no_file_matches_glob").when(looks, "looks_like_regex").otherwise("no_match"))


def snippets(hits: DataFrame, lines: DataFrame, n: int = 6) -> DataFrame:
    """hits with snippet: up to n lines on both sides, clipped at the file's ends, each marked is_match or not.

    Each hit asks for its 2 n + 1 line numbers and these are joined by file and line, so the work follows the hits.
    """
    asked = hits.select("path", "line_no").distinct().select("path", "line_no", F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line"))
    row = F.struct("line", "text", (F.col("line") == F.col("line_no")).alias("is_match"))
    near = asked.join(lines.select("path", F.col("line_no").alias("line"), "text"), ["path", "line"]).groupBy("path", "line_no").agg(F.array_sort(F.collect_list(row)).alias("snippet"))
    return hits.join(near, ["path", "line_no"])


def max_per_file(hits: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("path").orderBy("line_no")
    return hits.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")


def page(hits: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in a total order with has_more and next_offset; one row more than the page is read to know."""
    rows = hits.orderBy(*order).offset(offset).limit(limit + 1)
    rows = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit)
    return rows.filter(F.col("_n") <= limit).drop("_n").withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))


def cap(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows in a total order, with truncated; filters belong before it."""
    return page(df, order, 0, limit).withColumnRenamed("has_more", "truncated").drop("next_offset")


def rank_symbol_names(symbols: DataFrame, pattern: str) -> DataFrame:
    """symbols with rank: exact names first, then func, define, typedef, others, then by name."""
    exact = F.lower("name") == pattern.lower()
    kind = F.when(F.col("kind") == "func", 0).when(F.col("kind") == "define", 1).when(F.col("kind") == "typedef", 2).otherwise(3)
    return symbols.withColumn("rank", F.when(exact, -1).otherwise(kind))


def symbol_search(symbols: DataFrame, regex: str, kind: str | None, path: str, limit: int) -> DataFrame:
    """A pattern on names, a kind and a path filter; ranked, then capped."""
    found = symbols.filter(F.col("name").rlike(f"(?i){regex}") & P.path_condition(path))
    found = found.filter(F.col("kind") == kind) if kind else found
    return cap(rank_symbol_names(found, regex), ["rank", "name", "path", "line_no"], limit)


def _subsequence(chars: Column, part: str) -> Column:
    """The score of one part: 1 and the current run for every character found in order; null if one is missing."""
    letters = F.array(*map(F.lit, part))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("score"))

    def step(acc, c):
        hit = F.coalesce(F.get(letters, acc["at"]) == c, F.lit(False))
        run = F.when(hit, acc["run"] + 1).otherwise(0)
        return F.struct((acc["at"] + hit.cast("int")).alias("at"), run.alias("run"), (acc["score"] + F.when(hit, 1 + acc["run"]).otherwise(0)).alias("score"))

    done = F.aggregate(chars, start, step)
    return F.when(done["at"] == len(part), done["score"])


def fuzzy_score(path, query: str) -> Column:
    """Sum of the scores of the query's parts; null if one is missing."""
    chars = F.filter(F.split(F.lower(path), ""), lambda c: c != "")
    return sum((_subsequence(chars, part) for part in query.lower().split()), F.lit(0))


def fuzzy_rank(paths: DataFrame, query: str, k: int) -> DataFrame:
    return paths.withColumn("score", fuzzy_score(F.col("path"), query)).filter("score IS NOT NULL").orderBy(F.desc("score"), "path").limit(k)


def rank_by_tag(defs: DataFrame, tag: str) -> DataFrame:
    """defs(pos, ...) with new_pos: the tag's kind first, none dropped, otherwise in their order."""
    return defs.withColumn("new_pos", F.row_number().over(Window.partitionBy("name").orderBy((F.col("kind") != tag), "pos")))


def demote_non_source(defs: DataFrame, extensions: tuple = SOURCE_FILES) -> DataFrame:
    return defs.withColumn("new_pos", F.row_number().over(Window.partitionBy("name").orderBy(~path_ext("path").isin(*extensions), "pos")))


def hits_by_function(hits: DataFrame) -> DataFrame:
    """(path, func, n_hits, level) for every function, file and in all; level counts the names rolled up."""
    return hits.rollup("path", "func").agg(F.count("*").alias("n_hits"), F.grouping_id().alias("level"))


def list_dirs(files: DataFrame, rules: str = "", vendors: tuple = ("vendor", "node_modules", "third_party")) -> DataFrame:
    """(dir) at every level, without hidden, vendor and excluded subtrees."""
    left = exclude(files, rules) if rules else files
    dirs = left.select(path_dir("path").alias("d")).filter("d <> ''").distinct().select(F.explode(path_prefixes("d")).alias("dir")).distinct()
    return dirs.filter(~F.col("dir").rlike(r"(^|/)(\.[^/]*|" + "|".join(map(quoted, vendors)) + r")(/|$)"))


def macro_names(symbols: DataFrame) -> DataFrame:
    """Distinct names of macros and enum members that start like a name and hold a capital letter."""
    return symbols.filter(F.col("kind").isin("define", "enum_member") & F.col("name").rlike("^[A-Za-z_]") & F.col("name").rlike("[A-Z]")).select("name").distinct()


def tokens_in_file(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(path, name): known names that stand in each file as whole identifiers."""
    tokens = lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("name"))
    known = written(names.select("name").distinct(), "names")  # its size is known then; few are met before tokens are shuffled
    return tokens.join(known, "name", "left_semi").select("path", "name").distinct()


def foreign_rows(df: DataFrame, root: str) -> DataFrame:
    """Rows whose path is outside the root, whatever its case and slashes."""
    root = root.replace("\\", "/").rstrip("/").lower() + "/"
    return df.filter(~F.lower(F.regexp_replace("path", r"\\", "/")).startswith(root))


def decl_pattern_filter(sites: DataFrame, word: str | Column) -> DataFrame:
    """sites(path, line_no, text, func) without rows at file scope that look like a prototype of the word: one for all rows, or each row's own."""
    shown = F.array_contains(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)), word) if isinstance(word, Column) else F.col("text").rlike(rf"\b{quoted(word)}\s*\(")
    return sites.filter(F.col("func").isNotNull() | ~shown)
