"""Structure of C-like text as table jobs: code without comments, conditional regions, functions, macros, enums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import trimmed
from siltstone.functions.evaluate import eval_condition, eval_const
from siltstone.operators.joins import merged
from siltstone.operators.resolve import definition_body, enclosing_function, header_verdict, judged_definitions, later_verdict, prefer_definitions
from siltstone.sources.scratch import cut, written

LEXEME = r"""(//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|[^/"']+|/)"""
KEYWORDS = ("if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "defined", "goto", "typeof", "_Alignof", "alignof")
NAME = r"[A-Za-z_]\w*"
BLOCK_LINES = 64


def code_text(content) -> Column:
    """Content without comments, strings and characters; line numbers stay. Quotes end with their line."""
    blank = lambda s: F.regexp_replace(s, r"[^\n]", "")
    noise = lambda s: s.startswith("//") | s.startswith("/*") | s.startswith('"') | s.startswith("'")
    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(LEXEME), F.lit(1)), lambda s: F.when(noise(s), blank(s)).otherwise(s)), "")


def code_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text, code) of files(path, content)."""
    both = F.arrays_zip(F.split("content", "\n").alias("text"), F.split(code_text(F.col("content")), "\n").alias("code"))
    return files.select("path", F.posexplode(both).alias("i", "l")).select("path", (F.col("i") + 1).alias("line_no"), "l.text", F.coalesce("l.code", F.lit("")).alias("code"))


def files_with(files: DataFrame, word: str) -> DataFrame:
    """The files(path, content) that hold a word in their text, or in their code, where a comment within it is gone."""
    return files.filter(F.contains("content", F.lit(word)) | F.contains(code_text(F.col("content")), F.lit(word)))


def logical_lines(lines: DataFrame) -> DataFrame:
    """lines with first: the line where a run of lines joined by a final backslash begins."""
    by = Window.partitionBy("path").orderBy("line_no")
    return lines.withColumn("first", F.last(F.when(_starts(by), F.col("line_no")), ignorenulls=True).over(by))


def _starts(by) -> Column:
    """Whether the line before does not go on in this one."""
    return ~F.coalesce(F.lag("text").over(by).rlike(r"\\\s*$"), F.lit(False))


def conditional_regions(lines: DataFrame, of: str | None = None, so_far: str | None = None, whole: str | None = None) -> DataFrame:
    """(path, depth, group, branch, directive, condition, line_no, start_line, end_line): the body of every branch of #if ... #endif.

    With the columns of a number, its sum up to each line and its sum over the file: balance, its sum over the body.
    """
    at = r"^\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b\s*(.*?)\s*$"
    rows = lines.filter(F.col("code").rlike(at)).select("path", "line_no", F.regexp_extract("code", at, 1).alias("directive"), F.regexp_extract("code", at, 2).alias("condition"), *([of, so_far, whole] if of else []))
    by = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, closes = F.col("directive").isin("if", "ifdef", "ifndef"), F.col("directive") == "endif"
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(by) + F.when(closes, 1).otherwise(0))
    level = Window.partitionBy("path", "depth").orderBy("line_no")
    rows = rows.withColumn("group", F.sum(opens.cast("int")).over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy("path", "depth", "group").orderBy("line_no")
    rows = rows.withColumn("branch", F.row_number().over(inside)).withColumn("end_line", F.coalesce(F.lead("line_no").over(inside) - 1, F.lit(2147483647)))
    if of:
        rows = rows.withColumn("balance", F.coalesce(F.lead(F.col(so_far) - F.col(of)).over(inside), F.col(whole)) - F.col(so_far)).drop(of, so_far, whole)
    return rows.filter(~closes).withColumn("start_line", F.col("line_no") + 1)


def region_condition() -> Column:
    return F.when(F.col("directive") == "ifdef", F.concat(F.lit("defined("), "condition", F.lit(")"))).when(F.col("directive") == "ifndef", F.concat(F.lit("!defined("), "condition", F.lit(")"))).when(F.col("directive") == "else", F.lit("1")).otherwise(F.col("condition"))


def _inside(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows(path, line_no, ...) with the regions(path, start_line, end_line, ...) around each: both are dealt in blocks of BLOCK_LINES lines and joined by block, so that a long file is no product."""
    last = rows.groupBy("path").agg(F.max("line_no").alias("_last"))
    r = merged(regions.withColumnRenamed("line_no", "directive_line"), last, "path").withColumn("end_line", F.least("end_line", "_last")).filter("start_line <= end_line").drop("_last")
    block = lambda c: F.expr(f"{c} div {BLOCK_LINES}")
    r = r.withColumn("_block", F.explode(F.sequence(block("start_line"), block("end_line"))))
    joined = merged(rows.withColumn("_block", block("line_no")), r, ["path", "_block"])
    return joined.filter((F.col("line_no") >= F.col("start_line")) & (F.col("line_no") <= F.col("end_line"))).drop("_block")


def inactive_lines(lines: DataFrame, configs: DataFrame) -> DataFrame:
    """(config, path, line_no) that are dead under each of configs(config, defines map<string,int>).

    A branch is live if its condition holds, no earlier branch of its group was taken, and all around
    it are live; distinct conditions are evaluated once a config.
    """
    regions = conditional_regions(lines).withColumn("expr", region_condition())
    values = regions.select("expr").distinct().join(configs.select("config", "defines")).withColumn("value", eval_condition("expr", "defines")).drop("defines")
    held = regions.join(values, "expr")
    before = Window.partitionBy("config", "path", "depth", "group").orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("value") & ~F.coalesce(F.bool_or("value").over(before), F.lit(False))
    return _inside(lines.select("path", "line_no"), held.withColumn("taken", taken).filter("NOT taken")).select("config", "path", "line_no").distinct()


def _covered(rows: DataFrame, **regions: DataFrame) -> DataFrame:
    """rows(path, line_no, ...) with a column of each name: whether one of its regions(path, start_line, end_line) is around the row.

    Begins, ends and rows stand in one order by file and line, where a running sum counts what is open: no join.
    """
    every = rows.withColumn("_order", F.lit(1))
    for name, spans in regions.items():
        # both ends of a span come from one reading: a union of begins and ends would find the spans twice
        edge = lambda line, delta: F.struct(line.alias("line_no"), F.lit(delta).alias("delta"))
        edges = F.array(edge(F.col("start_line"), 1), edge(F.when(F.col("end_line") < 2147483647, F.col("end_line") + 1), -1))
        edges = spans.filter("start_line <= end_line").select("path", F.explode(edges).alias("e")).filter("e.line_no IS NOT NULL")
        every = every.unionByName(edges.select("path", "e.line_no", F.lit(0).alias("_order"), F.col("e.delta").alias(f"_{name}")), allowMissingColumns=True)
    run = Window.partitionBy("path").orderBy("line_no", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = {name: F.coalesce(F.sum(f"_{name}").over(run), F.lit(0)) > 0 for name in regions}
    return every.withColumns(around).filter("_order = 1").select(*rows.columns, *regions)


def _dead_regions(lines: DataFrame) -> DataFrame:
    """The regions in `#if 0` and in what follows `#if 1`."""
    inside = Window.partitionBy("path", "depth", "group").orderBy("branch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.when((F.col("branch") == 1) & (F.col("directive") == "if"), F.col("condition"))).over(inside)
    return conditional_regions(lines).withColumn("literal", first).filter("(literal = '0' AND branch = 1) OR (literal = '1' AND branch > 1)")


def dead_blocks(lines: DataFrame) -> DataFrame:
    """lines with code blanked in `#if 0` bodies and in the #else of `#if 1`; other conditions stay."""
    return _covered(lines, dead=_dead_regions(lines)).withColumn("code", F.when(F.col("dead"), "").otherwise(F.col("code"))).drop("dead")


def ifdef_stack(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits with ifdef_stack: the directives around each, outermost first."""
    frames = _inside(hits.select("path", "line_no").distinct(), conditional_regions(lines))
    stack = F.array_sort(F.collect_list(F.struct("depth", F.col("directive_line").alias("line"), "directive", "condition")))
    return merged(hits, frames.groupBy("path", "line_no").agg(stack.alias("ifdef_stack")), ["path", "line_no"], "left")


def _overcounted_regions(lines: DataFrame) -> DataFrame:
    """The branches after the first with braces out of balance, where two or more of one conditional are; the balance of a branch is the difference of two running sums."""
    b = F.regexp_count("code", F.lit(r"\{")) - F.regexp_count("code", F.lit(r"\}"))
    by = Window.partitionBy("path").orderBy("line_no")
    summed = lines.select("path", "line_no", "code", b.alias("b")).withColumn("so_far", F.sum("b").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("whole", F.sum("b").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    balance = conditional_regions(summed, "b", "so_far", "whole").filter("balance <> 0")
    return balance.withColumn("k", F.row_number().over(Window.partitionBy("path", "depth", "group").orderBy("branch"))).filter("k > 1")


def overcounted_branches(lines: DataFrame) -> DataFrame:
    """(path, line_no) of the branches after the first with braces out of balance, where two or more of one conditional are."""
    return _covered(lines.select("path", "line_no"), again=_overcounted_regions(lines)).filter("again").select("path", "line_no")


def top_spans(lines: DataFrame) -> DataFrame:
    """(path, head, start_line, end_line) of the outermost braces of each file, with what stands before them since the last statement.

    Directives with their continuations and over-counted branches hold no braces; lines(path, line_no, text, code).
    """
    held = _covered(lines.select("path", "line_no", "text", "code"), dead=_dead_regions(lines), again=_overcounted_regions(lines))
    held = held.withColumn("code", F.when(F.col("dead"), "").otherwise(F.col("code")))
    by = Window.partitionBy("path").orderBy("line_no")
    directive = F.last(F.when(_starts(by), F.col("code").rlike(r"^\s*#")), ignorenulls=True).over(by)
    live = held.withColumn("is_directive", directive)
    code = F.when(F.col("is_directive") | F.col("again"), "").otherwise(F.col("code"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "c"))), lambda s: s["c"])
    whole = live.withColumn("c", code).groupBy("path").agg(F.array_join(rows, "\n").alias("code"))
    part = F.lit(r"([^{};]*)([{};])")
    pairs = F.arrays_zip(F.regexp_extract_all("code", part, F.lit(1)).alias("before"), F.regexp_extract_all("code", part, F.lit(2)).alias("mark"))
    events = whole.select("path", F.posexplode(pairs).alias("k", "e")).select("path", "k", "e.before", "e.mark")
    by = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    depth = F.sum(F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)).over(by)
    events = events.withColumn("breaks", breaks(F.col("before"))).withColumn("line", F.sum("breaks").over(by) + 1).withColumn("depth", depth)
    head = F.regexp_replace("before", r"^\s+", "")
    skipped = breaks(F.substring("before", F.lit(1), F.length("before") - F.length(head)))
    edge = ((F.col("mark") == "{") & (F.col("depth") == 1)) | ((F.col("mark") == "}") & (F.col("depth") == 0))
    tops = events.filter(edge).withColumn("head", head).withColumn("start_line", F.col("line") - F.col("breaks") + skipped)
    tops = tops.withColumn("end_line", F.lead("line").over(Window.partitionBy("path").orderBy("k"))).filter("mark = '{' AND end_line IS NOT NULL")
    return tops.select("path", "head", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


def function_spans(lines: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line) of functions: outermost braces behind a name with brackets; lines(path, line_no, text, code)."""
    name = F.regexp_extract("head", rf"({NAME})\s*\([^()]*(?:\([^()]*\)[^()]*)*\)[\w\s]*$", 1)
    return top_spans(lines).withColumn("name", name).filter((F.col("name") != "") & ~F.col("name").isin(*KEYWORDS)).select("path", "name", "start_line", "end_line")


def outline(lines: DataFrame, indent: int = 2) -> DataFrame:
    """(path, name, detail, start_line, end_line): the functions that begin at most `indent` columns in, with their first line."""
    first = lines.select("path", F.col("line_no").alias("start_line"), "text")
    found = merged(function_spans(lines), first, ["path", "start_line"])
    return found.filter(F.length(F.regexp_extract("text", r"^([ \t]*)", 1)) <= indent).select("path", "name", trimmed("text").alias("detail"), "start_line", "end_line")


def _text_of(ranges: DataFrame, lines: DataFrame, key: list[str], wanted: Column | None = None) -> DataFrame:
    """(path, key..., body): the lines from start_line to end_line of each range, or those of an array of numbers, joined by line number."""
    asked = ranges.select("path", *key, F.explode(F.sequence("start_line", "end_line") if wanted is None else wanted).alias("_at"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda s: s["_text"])
    texts = lines.select("path", F.col("line_no").alias("_at"), F.col("text").alias("_text"))
    return merged(asked, texts, ["path", "_at"]).groupBy("path", *key).agg(F.array_join(rows, "\n").alias("body"))


def _comments_above(lines: DataFrame, most: int = 50) -> DataFrame:
    """(path, line_no, top, last) of lines with a comment right above, which stands from line top to line last; see leading_comment().

    One pass over the lines: a comment that ends in a line is told to the next one, and to the one after that if the next is blank.
    """
    t = trimmed("text")
    one = t.startswith("//") | (t.startswith("/*") & t.endswith("*/"))
    opens, closes = t.startswith("/*") & ~t.contains("*/"), t.endswith("*/") & (F.instr(t, "/*") == 0)
    by = Window.partitionBy("path").orderBy("line_no")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("path", "line_no", F.coalesce(F.lead(F.when(t == "", F.col("line_no"))).over(by) == F.col("line_no") + 1, F.lit(False)).alias("gap"), one.alias("one"), closes.alias("closes"), F.last(F.when(opens, F.col("line_no")), ignorenulls=True).over(so_far).alias("opened"))
    rows = rows.withColumn("block", F.when(F.col("closes") & (F.col("line_no") - F.col("opened") < most), F.col("opened")))
    # the last line that is no comment of one line, and where a block that ends there begins
    rows = rows.withColumn("other", F.last(F.when(~F.col("one"), F.struct("line_no", "block")), ignorenulls=True).over(so_far))
    other = F.coalesce("other.line_no", F.lit(0))
    row_top = F.when(F.col("one") & (F.col("line_no") - other <= most), F.coalesce("other.block", other + 1).cast("int"))
    found = rows.select("path", F.col("line_no").alias("last"), "gap", F.coalesce("block", row_top).alias("top")).filter("top IS NOT NULL")
    below = F.when(F.col("gap"), F.array(F.col("last") + 1, F.col("last") + 2)).otherwise(F.array(F.col("last") + 1))
    return found.select("path", F.explode(below).alias("line_no"), "top", "last")


def leading_comment(symbols: DataFrame, lines: DataFrame, most: int = 50) -> DataFrame:
    """(path, line_no, comment) of symbols(path, line_no) with a comment right above, one blank line between them at most.

    It is the lines of comments in a row, or one block of several lines, or both, the block first; a
    block or a row of more than `most` lines is none.
    """
    above = merged(_comments_above(lines, most), symbols.select("path", "line_no").distinct(), ["path", "line_no"])
    above = above.select("path", "line_no", F.col("top").alias("start_line"), F.col("last").alias("end_line"))
    return _text_of(above, lines, ["line_no"]).withColumnRenamed("body", "comment")


def function_body(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans(path, name, start_line, end_line) with body: the comment right above, if any, and the lines of each.

    The comments are found for all lines, so that the spans are read once.
    """
    above = _comments_above(lines).select("path", F.col("line_no").alias("start_line"), "top", "last")
    held = merged(spans, above, ["path", "start_line"], "left")
    comment = F.when(F.col("top").isNotNull(), F.sequence("top", "last")).otherwise(F.array().cast("array<int>"))
    return _text_of(held, lines, ["name", "start_line", "end_line"], F.concat(comment, F.sequence("start_line", "end_line")))


def define_blocks(lines: DataFrame, most: int = 30) -> DataFrame:
    """(path, line_no, name, params, body, truncated) of #define with its continuation lines, `most` at most."""
    at = rf"^\s*#\s*define\s+({NAME})(\([^)]*\))?\s*(.*)$"
    runs = logical_lines(lines)
    kept = F.when(F.col("line_no") - F.col("first") < most, F.struct("line_no", "text"))
    joined = runs.groupBy("path", "first").agg((F.max(F.col("line_no") - F.col("first")) >= most).alias("truncated"), F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: F.regexp_replace(s["text"], r"\\\s*$", "")), " ").alias("t"))
    clean = F.regexp_replace(F.regexp_replace("t", r"/\*.*?\*/", " "), r"//.*$", "")
    return joined.withColumn("t", clean).filter(F.col("t").rlike(at)).select("path", F.col("first").alias("line_no"), F.regexp_extract("t", at, 1).alias("name"), F.nullif(F.regexp_extract("t", at, 2), F.lit("")).alias("params"), F.trim(F.regexp_extract("t", at, 3)).alias("body"), "truncated")


def macro_values(macros: DataFrame, rounds: int = 6) -> DataFrame:
    """(name, value) of macros(name, params, body): constants after at most `rounds` substitutions of names.

    Conflicting bodies, macros with parameters and names that never settle have no value.
    """
    facts = macros.groupBy("name").agg(F.max("body").alias("most"), F.max(F.col("params").isNotNull()).alias("called"), F.min("body").alias("body"))
    facts = written(facts, "macros")  # each round reads it
    good = facts.filter("body = most AND NOT called").select("name", "body")
    now, settled = good.select("name", F.col("body").alias("expr")), []
    table = good.select(F.col("name").alias("used"), F.col("body").alias("by"))
    for _ in range(rounds):
        used = merged(now.select("name", F.explode(F.array_distinct(F.regexp_extract_all("expr", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))).alias("used")), table, "used")
        swaps = used.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("used", "by"))).alias("swaps"))
        put = lambda text, s: F.regexp_replace(text, F.concat(F.lit(r"\b"), s["used"], F.lit(r"\b")), F.concat(F.lit("("), F.regexp_replace(s["by"], r"([\\$])", r"\\$1"), F.lit(")")))
        expr = F.when(F.col("swaps").isNull(), F.col("expr")).otherwise(F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<used:string,by:string>>")), F.col("expr"), put))
        step = written(merged(now, swaps, "name", "left").select("name", expr.alias("expr"), F.col("swaps").isNotNull().alias("swapped")), "macros")
        settled.append(step.filter("NOT swapped").select("name", "expr"))
        now = step.filter("swapped").select("name", "expr")
        if now.isEmpty():
            break
    for part in settled:
        now = now.unionByName(part)
    return merged(facts.select("name"), now.select("name", eval_const("expr").alias("value")), "name", "left")


def enum_members(lines: DataFrame) -> DataFrame:
    """(path, enum, name, value, line_no): members of enum blocks; a literal sets the count, an unreadable value makes the rest unknown."""
    marked = lambda s: F.concat(F.lit("\u0001"), s["line_no"].cast("string"), F.lit("\u0002"), F.regexp_replace(s["code"], r"^\s*#.*$", "#,"))
    whole = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "code"))), marked), "").alias("t"))
    at = F.lit(rf"(\u0001\d+\u0002[^\u0001]*\benum\b\s*({NAME})?[^{{;]*)\{{([^}}]*)\}}")
    blocks = F.arrays_zip(F.regexp_extract_all("t", at, F.lit(1)).alias("head"), F.regexp_extract_all("t", at, F.lit(2)).alias("enum"), F.regexp_extract_all("t", at, F.lit(3)).alias("body"))
    rows = whole.select("path", F.posexplode(blocks).alias("b", "e")).select("path", "b", "e.head", "e.enum", F.posexplode(F.split("e.body", ",")).alias("i", "item"))
    last = lambda c: F.nullif(F.regexp_extract(c, "\u0001(\\d+)\u0002[^\u0001]*$", 1), F.lit(""))
    before = F.last(last("item"), ignorenulls=True).over(Window.partitionBy("path", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    own = F.nullif(F.regexp_extract("item", "^(?:\\s*\u0001(\\d+)\u0002)+", 1), F.lit(""))
    rows = rows.withColumn("line_no", F.coalesce(own, before, last("head"))).withColumn("item", F.trim(F.regexp_replace("item", "\u0001\\d+\u0002", " "))).filter("item <> ''")
    rows = rows.withColumn("name", F.regexp_extract("item", rf"^({NAME})\s*(?:=|$)", 1)).withColumn("set", F.nullif(F.trim(F.regexp_extract("item", r"=(.*)$", 1)), F.lit("")))
    value = eval_const("set")
    rows = rows.withColumn("literal", value).withColumn("bad", (F.col("name") == "") | (F.col("set").isNotNull() & F.col("literal").isNull()))
    by = Window.partitionBy("path", "b").orderBy("i")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("poison", F.bool_or("bad").over(run)).withColumn("k", F.row_number().over(by))
    rows = rows.withColumn("base", F.last(F.when(F.col("literal").isNotNull(), F.struct("literal", "k")), ignorenulls=True).over(run))
    counted = F.when(F.col("poison"), None).otherwise(F.coalesce(F.col("base.literal") + F.col("k") - F.col("base.k"), F.col("k") - 1))
    return rows.filter("name <> ''").select("path", F.concat_ws("#", "enum", F.col("b").cast("string")).alias("enum"), "name", counted.cast("long").alias("value"), F.col("line_no").try_cast("int").alias("line_no"))


def case_blocks(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """(path, line_no, label, start_line, end_line): the case region around each hit: stacked labels back to the first, until the next label at its depth; no case gives four lines each way.

    lines(path, line_no, code).
    """
    by = Window.partitionBy("path").orderBy("line_no")
    opens, closes = F.regexp_count("code", F.lit(r"\{")), F.regexp_count("code", F.lit(r"\}"))
    rows = lines.withColumn("depth", F.coalesce(F.sum(opens - closes).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    labels = rows.filter(F.col("code").rlike(r"^\s*(case\b.*|default\s*):")).withColumn("label", F.trim(F.regexp_extract("code", r"^\s*(case\b[^:]*|default)\s*:", 1))).withColumn("bare", F.col("code").rlike(r"^\s*(case\b[^:]*|default\s*):\s*$"))
    same = Window.partitionBy("path", "depth").orderBy("line_no")
    begins = ~F.coalesce(F.lag("bare").over(same) & (F.lag("line_no").over(same) == F.col("line_no") - 1), F.lit(False))
    labels = labels.withColumn("run", F.sum(begins.cast("int")).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = labels.groupBy("path", "depth", "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "label"))), lambda s: s["label"]), ", ").alias("label"))
    ends = rows.filter(F.col("code").rlike(r"^\s*\}")).select("path", (F.col("depth")).alias("depth"), F.col("line_no").alias("close"))
    nxt = F.lead("start_line").over(Window.partitionBy("path", "depth").orderBy("run")) - 1
    closed = merged(blocks.withColumn("next", nxt), ends, ["path", "depth"], "left").filter("close IS NULL OR close > last").groupBy("path", "depth", "run", "start_line", "last", "label", "next").agg(F.min("close").alias("close"))
    closed = closed.withColumn("end_line", F.least(F.coalesce("next", F.lit(2147483647)), F.coalesce(F.col("close") - 1, F.lit(2147483647))))
    around = merged(hits.select("path", "line_no").distinct(), closed, "path").filter("line_no BETWEEN start_line AND end_line")
    inner = around.withColumn("_k", F.row_number().over(Window.partitionBy("path", "line_no").orderBy(F.desc("start_line")))).filter("_k = 1").select("path", "line_no", "label", "start_line", "end_line")
    size = lines.groupBy("path").agg(F.max("line_no").alias("_n"))
    out = merged(merged(hits.select("path", "line_no").distinct(), inner, ["path", "line_no"], "left"), size, "path")
    return out.select("path", "line_no", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("start_line", F.greatest(F.lit(1), F.col("line_no") - 4)).alias("start_line"), F.coalesce("end_line", F.least(F.col("_n"), F.col("line_no") + 4)).alias("end_line"))


def _found(kinds: list[tuple[str, str]]) -> Column:
    """The first of kinds(kind, pattern) that a line of code fits, with the name in it, as rows."""
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("code", p, 1).alias("name")) for k, p in kinds]), lambda s: s["name"] != "")
    return F.slice(found, 1, 1)  # a filter on it would have every line searched again for each column


KINDS = [
    ("define", rf"^\s*#\s*define\s+({NAME})"), ("struct", rf"^\s*(?:typedef\s+)?struct\s+({NAME})\s*(?:\{{|$)"), ("union", rf"^\s*(?:typedef\s+)?union\s+({NAME})\s*(?:\{{|$)"),
    ("enum", rf"^\s*(?:typedef\s+)?enum\s+({NAME})\s*(?:\{{|$)"), ("typedef_close", rf"^\s*\}}\s*({NAME})\s*;"), ("typedef", rf"^\s*typedef\b.*\b({NAME})\s*;"), ("func", rf"^(?!\s)(?!typedef\b)(?:[\w*]+[\s*]+)+({NAME})\s*\([^;{{]*(?:\{{.*)?$"),
]
#: A function's header that ends with `;` in its line.
DECLARED = rf"^(?!\s)(?!typedef\b)(?:[\w*]+[\s*]+)+({NAME})\s*\([^;{{]*\)\s*;"


def line_definitions(lines: DataFrame) -> DataFrame:
    """(name, kind, path, line_no, text): what each line of code defines by itself, in one pass."""
    return lines.select("path", "line_no", "text", F.explode(_found(KINDS)).alias("d")).select("d.name", "d.kind", "path", "line_no", "text").filter(~F.col("name").isin(*KEYWORDS))


def extract_definitions(lines: DataFrame, ahead: int = 20) -> DataFrame:
    """(name, kind, path, line_no, text): definitions of all names, members of enums included; lines(path, line_no, text, code).

    A function's header is what the up to `ahead` lines behind it make of it (see resolve.judge_definitions()): a
    definition, a declaration, or no row where it names another function. Names with a definition lose their
    declarations, and headers go where an implementation file has the same kind of a name. What is behind a line is
    told by windows over the lines of its file, among which the members stand: no join.
    """
    members = enum_members(lines).select("path", "line_no", F.array(F.struct(F.lit("enum_member").alias("kind"), "name")).alias("found"))
    rows = lines.select("path", "line_no", "text", _found([*KINDS, ("declared", DECLARED)]).alias("found"), F.trim("text").alias("full"), definition_body("text").alias("body"))
    by = Window.partitionBy("path").orderBy("line_no")
    behind = lambda c, last: F.first(c, ignorenulls=True).over(by.rangeBetween(1, last))
    told = rows.unionByName(members, allowMissingColumns=True).withColumns({
        "text": F.max("text").over(by.rangeBetween(0, 0)), "_line": F.col("full"),
        "_def": F.coalesce(header_verdict(F.col("body")), behind(later_verdict(F.col("body")), ahead)),
        "_next": behind(F.when(F.col("full") != "", F.col("full")), 3),
    })
    every = told.select("path", "line_no", "text", "_line", "_def", "_next", F.explode("found").alias("d")).select("d.name", "d.kind", "path", "line_no", "text", "_line", "_def", "_next").filter(~F.col("name").isin(*KEYWORDS))
    every = every.withColumn("kind", F.when(F.col("kind") == "declared", "func").otherwise(F.col("kind")))
    judged = judged_definitions(every).filter("NOT wrong_name").withColumn("is_def", F.col("is_def") & ~F.col("annotation"))
    return prefer_definitions(judged.select("name", "kind", "path", "line_no", "text", "is_def")).drop("is_def")


def call_edges(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, caller, callee, line_no): names followed by a bracket inside functions, the first line of each; headers, keywords and function-pointer declarations left out."""
    inside = enclosing_function(lines.select("path", "line_no", "code"), spans).filter("func IS NOT NULL")
    at = rf"\b({NAME})\s*\("
    pointers = F.regexp_extract_all("code", F.lit(rf"\(\s*\*\s*({NAME})\s*\)\s*\("), F.lit(1))
    declared = F.regexp_extract_all("code", F.lit(rf"\b({NAME})\s*\(\s*\*\s*{NAME}\s*\)\s*\("), F.lit(1))
    names = F.array_except(F.array_distinct(F.regexp_extract_all("code", F.lit(at), F.lit(1))), F.concat(pointers, declared))
    rows = inside.select("path", "func", "func_line", "line_no", "code", F.explode(names).alias("callee")).filter(~F.col("callee").isin(*KEYWORDS))
    header = (F.col("callee") == F.col("func")) & (F.col("line_no") == F.col("func_line")) | (F.col("callee") == F.col("func")) & F.regexp_like("code", F.concat(F.lit(r"^\w[\w\s*]*\b"), "callee", F.lit(r"\s*\([^;{]*(\{|$)")))
    return rows.filter(~header).groupBy("path", F.col("func").alias("caller"), "callee").agg(F.min("line_no").alias("line_no"))


def callers(edges: DataFrame, mentions: DataFrame, word: str) -> DataFrame:
    """(path, func, line_no, indirect): call edges and mentions(path, func, line_no) of a word, a direct site winning in a function; the word's own function left out."""
    direct = edges.filter(F.col("callee") == word).select("path", F.col("caller").alias("func"), "line_no", F.lit(False).alias("indirect"))
    both = direct.unionByName(mentions.select("path", "func", "line_no", F.lit(True).alias("indirect"))).filter(F.coalesce(F.col("func") != word, F.lit(True)))
    key = F.coalesce("func", F.concat(F.lit("@"), F.col("line_no").cast("string")))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy("path", key).orderBy("indirect", "line_no"))).filter("_k = 1").drop("_k")


def alias_chain(macros: DataFrame, most: int = 4) -> DataFrame:
    """(root, place, name): the macros that each macro's body leads to, breadth first, each once, `most` at most; macros(name, body)."""
    once = written(macros.groupBy("name").agg(F.min("body").alias("body")), "macros")
    used = once.select("name", F.posexplode(F.array_distinct(F.regexp_extract_all("body", F.lit(rf"({NAME})"), F.lit(1)))).alias("k", "used"))
    edges = written(merged(used, once.select(F.col("name").alias("used")), "used").filter("used <> name"), "aliases")
    front = edges.select(F.col("name").alias("root"), F.col("used").alias("name"), F.array("k").alias("way"))
    every = front
    for _ in range(most - 1):
        step = merged(front, edges.select("name", "used", "k"), "name").filter("used <> root")
        front = step.select("root", F.col("used").alias("name"), F.array_append("way", F.col("k")).alias("way"))
        front = written(front.groupBy("root", "name").agg(F.min("way").alias("way")), "aliases")
        every = every.unionByName(front)
    first = every.groupBy("root", "name").agg(F.min(F.struct(F.size("way").alias("n"), "way")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("at"))).filter(F.col("place") <= most).select("root", "place", "name")


def static_names(lines: DataFrame) -> DataFrame:
    """(path, name, line_no): where the static variables of a file stand in its code, not as members and not as names of types; lines(path, line_no, code)."""
    at = rf"\bstatic\b(?:\s+(?:const|volatile|unsigned|signed|long|short|inline))*\s+(?:(?:struct|enum|union)\s+)?\w+\s*\**\s*({NAME})\s*(?=[=;\[])"
    names = lines.filter(F.col("code").contains("static")).select("path", F.regexp_extract("code", at, 1).alias("name")).filter("name <> ''").groupBy("path").agg(F.collect_set("name").alias("names"))
    words = F.array_distinct(F.regexp_extract_all("code", F.lit(rf"(?<![>.\w])(?<!\b(?:struct|enum|union)\s{{1,9}})({NAME})"), F.lit(1)))
    return merged(lines.select("path", "line_no", "code"), names, "path").select("path", F.explode(F.array_intersect(words, "names")).alias("name"), "line_no")


def typedef_targets(typedefs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, target, kind, path, line_no): the struct, union or enum that an alias without a body stands for; typedefs(name, text), symbols(name, kind, path, line_no)."""
    alias = typedefs.filter(~F.col("text").contains("{")).select("name", F.regexp_extract("text", rf"typedef\s+(?:struct|union|enum)\s+({NAME})", 1).alias("target")).filter("target <> ''").distinct()
    held = symbols.filter(F.col("kind").isin("struct", "union", "enum")).select(F.col("name").alias("target"), "kind", "path", "line_no")
    return merged(alias, held, "target").select("name", "target", "kind", "path", "line_no")


def symbol_cards(words: DataFrame, lines: DataFrame, most: int = 2) -> DataFrame:
    """(name, kind, path, line_no, body, value, decl) of each definition of words(name): what to show for a name.

    The body is the comment right above and the function, the outermost block of a struct, union or enum, the
    define with its continuation, or else the line. value: of macros and enum members that are constants.
    Of functions `most` implementations are shown, and declarations, `most` at most, only where there is none.
    """
    lines = cut(lines)  # read many times below
    defs = line_definitions(lines).withColumn("decl", F.lit(False))
    said = lines.withColumn("name", F.regexp_extract("code", DECLARED, 1)).filter("name <> ''").select("name", F.lit("func").alias("kind"), "path", "line_no", "text", F.lit(True).alias("decl"))
    members = enum_members(lines).select("name", F.lit("enum_member").alias("kind"), "path", "line_no", F.lit(False).alias("decl"), F.col("value"))
    values = cut(macro_values(cut(define_blocks(lines))).filter("value IS NOT NULL")).select("name", F.lit("define").alias("kind"), "value")
    every = merged(defs.unionByName(said), values, ["name", "kind"], "left").unionByName(merged(members, lines.select("path", "line_no", "text"), ["path", "line_no"]), allowMissingColumns=True)
    wanted = merged(every, words.select("name").distinct(), "name", "left_semi").dropDuplicates(["name", "kind", "path", "line_no"])
    k = F.row_number().over(Window.partitionBy("name", "decl", F.col("kind") == "func").orderBy("path", "line_no"))
    real = F.max(((F.col("kind") == "func") & ~F.col("decl")).cast("int")).over(Window.partitionBy("name"))
    func = F.col("kind") == "func"
    shown = cut(wanted.withColumn("_k", k).withColumn("_real", real).filter(~func | ((F.col("_k") <= most) & (~F.col("decl") | (F.col("_real") == 0)))).drop("_k", "_real"))
    spans = top_spans(lines).select("path", F.col("start_line").alias("line_no"), "end_line")
    runs = logical_lines(lines).groupBy("path", F.col("first").alias("line_no")).agg(F.max("line_no").alias("run_end"))
    ends = merged(merged(shown, spans, ["path", "line_no"], "left"), runs, ["path", "line_no"], "left")
    block = F.col("kind").isin("func", "struct", "union", "enum") & ~F.col("decl")
    ends = ends.withColumn("start_line", F.col("line_no")).withColumn("end_line", F.when(F.col("kind") == "define", F.col("run_end")).when(block, F.coalesce("end_line", "line_no")).otherwise(F.col("line_no")))
    body = _text_of(ends.select("path", "line_no", "start_line", "end_line").distinct(), lines, ["line_no"])
    comment = leading_comment(shown, lines)
    return merged(merged(shown, body, ["path", "line_no"]), comment, ["path", "line_no"], "left").select("name", "kind", "path", "line_no", F.concat_ws("\n", "comment", "body").alias("body"), "value", "decl")
