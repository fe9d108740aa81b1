"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.stored import maybe_in, stored

#: Longer lines put out their neighbourhood as rows and running windows, so that work stays in proportion to their length.
LONG = 1024
#: Letters of scripts written without blanks, and marks on them: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\\x{20000}-\\x{323af}]"


def _words(line, apart: bool = False):
    if apart:
        line = F.when(F.octet_length(line) > F.char_length(line), F.regexp_replace(line, UNSPACED, " $0 ")).otherwise(line)
    for c in ("\t", "\x0b", "\x0c", "\r"):
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def _half_keys():
    """Hashes of the first and last half of a line, halved as it stands and as a line one word shorter."""
    keys = []
    for base in ("w", "w - 1"):
        half = f"({base}) div 2"
        keys.append(F.expr(f"xxhash64(slice(words, 1, cast({half} as int)), {base}, 0)"))
        keys.append(F.expr(f"xxhash64(slice(words, cast(w - ({base} - {half}) + 1 as int), cast({base} - {half} as int)), {base}, 1)"))
    return F.array(*keys)


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(doc, no, w, i, k): k stands for the words of a line (i = -1), or for them without word i.

    k is the xor of a hash of each word with its place; places behind the word left out are one less.
    """
    step = "xxhash64(words[j], j) ^ xxhash64(words[j + 1], j)"
    short = lines.filter(F.col("w") <= LONG).withColumn(
        "ks",
        F.expr(f"""aggregate(sequence(0, w - 2), struct(aggregate(sequence(1, w - 1), 0L, (a, j) -> a ^ xxhash64(words[j], j - 1)) as now, cast(array() as array<bigint>) as done),
            (s, j) -> struct(s.now ^ {step} as now, array_append(s.done, s.now) as done), s -> array_append(s.done, s.now))"""),
    )
    whole = F.expr("aggregate(sequence(0, w - 1), 0L, (a, j) -> a ^ xxhash64(words[j], j))")
    short = short.withColumn("ks", F.array_append("ks", whole)).select("doc", "no", "w", F.posexplode("ks").alias("i", "k"))
    short = short.withColumn("i", F.when(F.col("i") == F.col("w"), -1).otherwise(F.col("i")))
    long = lines.filter(F.col("w") > LONG).select("doc", "no", "w", F.posexplode("words").alias("i", "word"))
    by = Window.partitionBy("doc", "no").orderBy("i")
    before, behind = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy("doc", "no").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    here, less = F.expr("xxhash64(word, i)"), F.expr("xxhash64(word, i - 1)")
    zero = F.lit(0).cast("long")
    long = long.withColumn("here", here).withColumn("less", less)
    cut = long.select("doc", "no", "w", "i", F.coalesce(F.bit_xor("here").over(before), zero).bitwiseXOR(F.coalesce(F.bit_xor("less").over(behind), zero)).alias("k"))
    full = long.groupBy("doc", "no", "w").agg(F.lit(-1).alias("i"), F.bit_xor("here").alias("k"))
    return short.unionByName(cut).unionByName(full)


def _within_one_edit():
    """Whether the word arrays a and b differ by one word inserted, deleted or replaced, in one pass over each."""
    same = "zip_with(x, y, (p, q) -> p = q)"
    lead = "coalesce(nullif(array_position({s}, false), 0) - 1, size({s}))"
    x, y = "if(size(a) <= size(b), a, b)", "if(size(a) <= size(b), b, a)"
    head = lead.format(s=same.replace("x,", f"{x},", 1).replace("y,", f"slice({y}, 1, size({x})),", 1))
    tail = lead.format(s="reverse(" + same.replace("x,", f"{x},", 1).replace("y,", f"slice({y}, size({y}) - size({x}) + 1, size({x})),", 1) + ")")
    return F.expr(f"abs(size(a) - size(b)) <= 1 and {head} + {tail} >= greatest(size(a), size(b)) - 1")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, whole: bool = True) -> DataFrame:
    """(doc, no) of the lines that stay; see dedup_lines."""
    if min_words < 2:
        raise ValueError("a line of one word has no neighbourhood: min_words is 2 at least")
    split = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    words = split.withColumn("words", _words(F.col("line"), whole)).withColumn("w", F.size("words"))
    long_enough = F.col("w") >= min_words
    judged = F.col("w") >= 1 if whole else long_enough
    hashed = stored(words.select("doc", "no", F.when(judged, F.col("w")).alias("w"), F.when(judged, F.xxhash64("words")).alias("self"), F.when(judged, F.xxhash64(F.lit(1), "words")).alias("self2"), F.when(long_enough, _half_keys()).alias("halves")), "lines")

    at = F.struct("doc", "no")
    copies = hashed.filter("w IS NOT NULL").groupBy("self", "self2").agg(F.min(F.struct("doc", "no", "w", "halves")).alias("f"))
    first = stored(copies.select("self", "f.doc", "f.no", "f.w", "f.halves"), "firsts")

    # lines that share a half with another: halves are counted before they meet, so that a common one is one row a task
    halves = first.select("doc", "no", "self", F.explode("halves").alias("half"))
    shared = stored(halves.groupBy("half").agg(F.min("self").alias("lo"), F.max("self").alias("hi")).filter("lo < hi").select("half"), "halves")
    active = stored(maybe_in(halves, ["half"], shared).join(shared, "half", "left_semi").select("doc", "no").distinct(), "active")

    # the words of the active lines: a bitmap passes over the other lines before they are split
    near = maybe_in(split, ["doc", "no"], active).select("doc", "no", _words(F.col("line"), whole).alias("words"))
    near = stored(near.join(active, ["doc", "no"], "left_semi").dropDuplicates(["doc", "no"]).withColumn("w", F.size("words")), "near")

    # the earliest line of each key, as it stands and without a word, and those keys alone that several lines have
    keys = _neighbourhood(near)
    least = lambda c: F.min(F.when(c, at))
    common = keys.groupBy("k").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), least(F.col("i") == -1).alias("shorter"), least(F.col("i") >= 0).alias("longer"))
    common = stored(common.filter("lo < hi").drop("lo", "hi"), "keys")
    keys = stored(maybe_in(keys, ["k"], common), "held")
    one_more = keys.join(common, "k").select("doc", "no", F.when(F.col("i") == -1, F.col("longer")).otherwise(F.col("shorter")).alias("m"))
    same = stored(keys.filter("i >= 0").groupBy("k", "w", "i").agg(F.min(at).alias("m"), F.max(at).alias("hi")).filter("m < hi").drop("hi"), "replaced")
    replaced = keys.join(same, ["k", "w", "i"]).select("doc", "no", "m")
    found = one_more.unionByName(replaced).filter(F.col("m") < at).groupBy("doc", "no").agg(F.min("m").alias("m")).select("doc", "no", F.col("m.doc").alias("mdoc"), F.col("m.no").alias("mno"))
    pairs = found.join(near.select("doc", "no", F.col("words").alias("a")), ["doc", "no"]).join(near.select(F.col("doc").alias("mdoc"), F.col("no").alias("mno"), F.col("words").alias("b")), ["mdoc", "mno"])
    edited = pairs.filter(_within_one_edit()).select("doc", "no")
    return first.select("doc", "no").join(edited, ["doc", "no"], "left_anti").unionByName(hashed.filter("w IS NULL").select("doc", "no"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, whole: bool = True) -> DataFrame:
    """docs with text_col rewritten and the columns n_lines, n_removed: each line that has an earlier twin is removed.

    Lines are compared as sequences of words (runs other than 0x20, 0x09-0x0D). A line of min_words
    words or more is removed if an earlier line, by (id, line number), is at most one word inserted,
    deleted or replaced away, whether that one stays or not. Equal lines fall to
    their earliest. For the others, every line puts out its deletion neighbourhood as hashed keys: its
    words, and its words without each one. A key equal to another line's words is one insertion away,
    and equal keys with the same place left out are one replacement away; so lines under one key are
    within the bound of its earliest line, a minimum finds it without pairs, and the match is verified
    on the words. Only lines that share their first or last half with another line take part, which
    loses nothing: one edit leaves the half before or behind it as it was. Lines longer than LONG
    words make their keys by windows over their words.

    No line stays for its size: one under min_words that holds a word falls to an earlier line of equal
    words, and every letter of a script written without blanks counts as a word of its own, so that
    such lines reach min_words and take part in the search. Lines without a word stay. Without whole,
    lines under min_words stay, and letters don't count apart. min_words is 2 at least.

    Null text stays null, with 0 lines; empty text is one short line. Rows with a null id stay as they
    are and remove nothing. Rows that share an id count as one document. Extra columns stay, but for
    n_lines and n_removed, which are replaced. An empty table gives an empty one.
    """
    stay = kept_lines(docs, id_col, text_col, min_words, whole).groupBy("doc").agg(F.array_sort(F.collect_set("no")).alias("stay"))
    # the caller's row travels as one struct, so that no name of its can clash
    rows = docs.drop("n_lines", "n_removed").select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.split(text_col, "\n").alias("lines"))
    text = F.col("row").getField(text_col)
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    kept = F.when(F.col("id").isNotNull() & F.col("lines").isNotNull(), F.coalesce(F.col("stay"), F.array().cast("array<int>")))
    left = F.when(kept.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    cols = [left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.join(stay, F.col("id") == F.col("doc"), "left").select(*cols, n.cast("long").alias("n_lines"), (n - F.coalesce(F.size(kept), n)).cast("long").alias("n_removed"))
