"""State transitions: from event tables and from code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import common_prefix, quoted, trimmed
from siltstone.functions.flow import Scan
from siltstone.operators.joins import merged
from siltstone.operators.resolve import enclosing_function
from siltstone.operators.search import cap
from siltstone.operators.structure import code_lines, code_text, function_spans
from siltstone.sources.scratch import cut

MOST_STATES = 48


def event_transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """events with from and to: each entity's state before and after a row; the first row of an entity has none before."""
    by = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("from", F.lag(state).over(by)).withColumn("to", F.col(state)).filter("from IS NOT NULL")


def classify_rhs(rhs) -> Column:
    """(kind, value): one capitalised name is a state, also in one pair of brackets that holds no other; anything else an expression."""
    t = trimmed(rhs)
    bare = F.when(t.rlike(r"^\([^()]*\)$"), trimmed(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    return F.struct(F.when(bare.rlike(r"^[A-Z][A-Za-z0-9_]*$"), "state").otherwise("expr").alias("kind"), bare.alias("value"))


def state_summary(transitions: DataFrame) -> DataFrame:
    """(from, to, func, via, n, lines, fell_through) of transitions(from_states array, to, func, via, line_no, fell array); an unknown source has an empty name."""
    rows = transitions.select("to", "func", "via", "line_no", "fell", F.explode_outer("from_states").alias("from")).withColumn("from", F.coalesce("from", F.lit("")))
    return rows.groupBy("from", "to", "func", "via").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line_no")).alias("lines"), F.bool_or(F.array_contains("fell", F.col("from"))).alias("fell_through"))


def transition_matrix(transitions: DataFrame, states: list[str]) -> DataFrame:
    """One row a source state with a count for each state it leads to."""
    return transitions.groupBy("from").pivot("to", states).agg(F.count(F.lit(1))).na.fill(0)


def successors(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("from").agg(F.array_sort(F.collect_set("to")).alias("to_states"), F.count("*").alias("n"))


def plausible_universe(universe: DataFrame, observed: DataFrame) -> DataFrame:
    """One row (plausible): not over three times the observed states plus 4, and not (4 valued states or more with over a third sharing values)."""
    n = observed.agg(F.count_distinct("name").alias("seen"))
    u = universe.agg(F.count("*").alias("size"), F.count("value").alias("valued"), F.count_distinct("value").alias("values"))
    fair = (F.col("size") <= 3 * F.col("seen") + 4) & ~((F.col("valued") >= 4) & (3 * (F.col("valued") - F.col("values")) > F.col("valued")))
    return u.crossJoin(n).select(fair.alias("plausible"), "size", "seen")  # one row each


def dead_states(universe: DataFrame, transitions: DataFrame) -> DataFrame:
    """(name, assigned, observed) of every state of the universe."""
    to = transitions.select(F.col("to").alias("name")).distinct().withColumn("_a", F.lit(True))
    seen = transitions.select(F.col("from").alias("name")).union(transitions.select("to")).distinct().withColumn("_o", F.lit(True))
    joined = universe.select("name").distinct().join(to, "name", "left").join(seen, "name", "left")
    return joined.select("name", F.coalesce("_a", F.lit(False)).alias("assigned"), F.coalesce("_o", F.lit(False)).alias("observed"))


def order_states(states: DataFrame) -> DataFrame:
    """states(name, value) with place: by number, those without one last by name."""
    number = F.col("value").try_cast("long")
    # places within ranges of values, and behind them those of the ranges before: no task holds all
    keyed = states.withColumn("_none", number.isNull()).withColumn("_n", number).repartitionByRange("_none", "_n", "name").withColumn("_part", F.spark_partition_id())
    keyed = cut(keyed)
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = sizes.withColumn("_before", before).drop("_size")
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_none", "_n", "name"))
    return keyed.withColumn("_own", own).join(offsets, "_part").withColumn("place", F.col("_own") + F.col("_before")).select(*states.columns, "place")


def state_universe(observed: DataFrame, enums: DataFrame, defines: DataFrame) -> DataFrame:
    """(name, value, family, truncated): the enum of two members or more that holds an observed name; else the defines of the observed names' common prefix; else the observed names.

    enums(enum, name, value), defines(name, value). A prefix ends with an underscore and has 3 characters or more.
    """
    sizes = enums.groupBy("enum").agg(F.count("*").alias("n")).filter("n >= 2")
    hit = enums.join(observed.select("name").distinct(), "name", "left_semi").select("enum").distinct().join(sizes, "enum")
    from_enum = enums.join(hit, "enum", "left_semi").select("name", F.col("value").cast("string").alias("value"), F.lit("enum").alias("family"), F.lit(0).alias("p"))
    prefix = observed.agg(F.regexp_extract(common_prefix(F.min("name"), F.max("name")), r"^(.*_)", 1).alias("prefix")).filter("length(prefix) >= 3")
    from_define = defines.join(prefix, F.col("name").startswith(F.col("prefix"))).select("name", F.col("value").cast("string").alias("value"), F.lit("define").alias("family"), F.lit(1).alias("p"))
    own = observed.select("name").distinct().select("name", F.lit(None).cast("string").alias("value"), F.lit("observed").alias("family"), F.lit(2).alias("p"))
    every = from_enum.unionByName(from_define).unionByName(own)
    best = every.agg(F.min("p").alias("p"))
    return cap(every.join(F.broadcast(best), "p").dropDuplicates(["name"]).drop("p"), ["name"], MOST_STATES)  # best is one row


def latest_state(events: DataFrame, key: str, order: Column, value: str, at: str, now: Column, fresh: str = "20 seconds") -> DataFrame:
    """(key, value, age_s, fresh): the last value of each key; stale ones stay."""
    last = events.groupBy(key).agg(F.max_by(value, order).alias("value"), F.max(at).alias("at"))
    now, at_time = now.cast("timestamp"), F.col("at").cast("timestamp")
    age = now.cast("double") - at_time.cast("double")
    return last.select(key, "value", age.alias("age_s"), (at_time >= now - F.expr(f"INTERVAL {fresh}")).alias("fresh"))


CHANGE = "path string, line_no int, rhs string, via string, from_states array<string>, from_kind string, fell array<struct<name: string, set_line: int>>"
#: A directive with its continuation lines.
DIRECTIVE = r"(?m)^[ \t]*#(?:[^\n]*\\[ \t]*\n)*[^\n]*"


def code_transitions(files: DataFrame, var: str, helpers: DataFrame | None = None) -> DataFrame:
    """(path, func, line_no, from_states, from_kind, to, to_expr, via, fell): assignments to a variable or member, with the states it can come from.

    from_states is null where nothing can be told. to is a state, to_expr any other right side. fell: the
    states that come from the case above, with the line that set them. helpers(name, arg_index): calls
    that assign a capitalised argument, as transitions `via` them. Only files that match a pattern are
    scanned, each by one pass over its code in an Arrow batch; the calls of helpers in a file are found by a join.
    Code behind more than 120 open blocks (flow.DEEPEST) is not read: from_states is null there.
    """
    rows = cut(code_changes(files, var, helpers).withColumn("c", classify_rhs(F.col("rhs"))))
    lines = code_lines(merged(files, rows.select("path").distinct(), "path", "left_semi"))
    rows = enclosing_function(rows, function_spans(lines))
    to = lambda kind: F.when(F.col("c.kind") == kind, F.col("c.value"))
    return rows.select("path", "func", "line_no", "from_states", "from_kind", to("state").alias("to"), to("expr").alias("to_expr"), F.nullif("via", F.lit("")).alias("via"), "fell")


def code_changes(files: DataFrame, var: str, helpers: DataFrame | None = None) -> DataFrame:
    """(path, line_no, rhs, via, from_states, from_kind, fell): code_transitions() as they are read, without the functions around them."""
    hit = F.col("content").rlike(rf"\b{quoted(var)}\b\s*=(?:[^=]|$)")
    if helpers is None:
        asked = files.filter(hit).withColumn("helpers", F.create_map().cast("map<string,int>"))
    else:
        called = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))))
        known = merged(files.select("path", called.alias("name")), helpers.select("name", "arg_index").dropDuplicates(["name"]), "name")
        found = known.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("arg_index").cast("int")))).alias("helpers"))
        asked = merged(files, found, "path", "left").filter(hit | F.col("helpers").isNotNull())
    code = asked.select("path", code_text(F.col("content")).alias("code"), "helpers")

    def scan(batches):
        for pdf in batches:
            out = []
            for path, text, calls in zip(pdf["path"], pdf["code"], pdf["helpers"], strict=True):
                text = re.sub(DIRECTIVE, lambda m: "\n" * m[0].count("\n"), text)
                for c in Scan(text, var, dict(calls) if calls is not None else {}).run():
                    names = None if c.before.names is None else list(c.before.names)
                    out.append((path, c.line, c.rhs, c.via, names, c.before.kind, [{"name": n, "set_line": at} for n, at in c.fell]))
            yield pd.DataFrame(out, columns=["path", "line_no", "rhs", "via", "from_states", "from_kind", "fell"])

    return code.mapInPandas(scan, CHANGE)


def fell_through(transitions: DataFrame) -> DataFrame:
    """(path, line_no, name, set_line): the states that reach an assignment from the case above, and where each was set; 0 where it was a label."""
    return transitions.select("path", "line_no", F.explode("fell").alias("f")).select("path", "line_no", "f.name", "f.set_line")


def parameters(files: DataFrame) -> DataFrame:
    """(path, func, name, arg_index) of every function's parameters, by the last name of each declaration."""
    lines = code_lines(files)
    spans = function_spans(lines)
    asked = spans.select("path", F.col("name").alias("func"), "start_line", F.explode(F.sequence("start_line", F.least("end_line", F.col("start_line") + 9))).alias("line_no"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "code"))), lambda s: s["code"])
    heads = merged(asked, lines.select("path", "line_no", "code"), ["path", "line_no"]).groupBy("path", "func", "start_line").agg(F.array_join(rows, " ").alias("head"))
    plain = F.regexp_replace("head", r"\(\s*\*\s*(\w+)\s*\)\s*\([^()]*\)", "$1")  # pointers to functions by their names
    inside = F.regexp_extract(plain, r"\(([^()]*)\)", 1)
    parts = F.transform(F.split(inside, ","), lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\W*$", 1))
    return heads.select("path", "func", F.posexplode(parts).alias("arg_index", "name")).filter("name <> ''").select("path", "func", "name", "arg_index")


def helper_functions(transitions: DataFrame, params: DataFrame) -> DataFrame:
    """(name, arg_index): functions that assign one of their own parameters, joined by the parameter's name."""
    own = transitions.filter("to IS NULL AND func IS NOT NULL").select("path", "func", F.col("to_expr").alias("name"))
    return merged(own, params, ["path", "func", "name"]).groupBy(F.col("func").alias("name")).agg(F.min("arg_index").alias("arg_index"))


def helper_transitions(files: DataFrame, var: str, transitions: DataFrame | None = None) -> DataFrame:
    """Transitions of constant arguments to functions that assign their parameter, one level only; not inside such functions, and not where an assignment stands."""
    direct = cut(code_transitions(files, var) if transitions is None else transitions)
    named = merged(files, direct.filter("to IS NULL").select("path").distinct(), "path", "left_semi")
    helpers = cut(helper_functions(direct, parameters(named)))
    found = code_transitions(files, var, helpers).filter("via IS NOT NULL")
    found = merged(found, helpers.select(F.col("name").alias("func")), "func", "left_anti")
    return merged(found, direct.select("path", "line_no").distinct(), ["path", "line_no"], "left_anti")
