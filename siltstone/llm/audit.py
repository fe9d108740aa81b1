"""What each of a few filters removes, in any order: exact counts and Shapley values from coalitions."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.stored import stored

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that look at a text alone, by letter: few words, few different words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def shapley(removed: list[int], m: int) -> list[Fraction]:
    """The Shapley value of each of m filters; removed[s]: rows that the coalition of the bits of s removes.

    Least squares over all proper coalitions with the kernel weights (m - 1) / (C(m, k) k (m - k)), held
    to the sum of all values being removed[all]: normal equations with one multiplier, solved in
    rationals by elimination. With these weights the solution is the Shapley value itself.
    """
    every = (1 << m) - 1
    if m == 1:
        return [Fraction(removed[every])]
    rows = [[Fraction(0)] * (m + 2) for _ in range(m + 1)]
    for s in range(1, every):
        k = s.bit_count()
        weight = Fraction(m - 1, math.comb(m, k) * k * (m - k))
        members = [i for i in range(m) if s >> i & 1]
        for i in members:
            for j in members:
                rows[i][j] += weight
            rows[i][m + 1] += weight * removed[s]
    for i in range(m):
        rows[i][m] = rows[m][i] = Fraction(1)
    rows[m][m + 1] = Fraction(removed[every])
    for i in range(m + 1):
        at = next(r for r in range(i, m + 1) if rows[r][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(m + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [rows[i][m + 1] for i in range(m)]


def coalitions(counts: dict[int, int], m: int) -> list[int]:
    """Rows that each of the 2**m coalitions removes; counts: rows by the set of filters that they fail."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(1 << m)]


def order_steps(masks: pd.DataFrame, letters: str) -> pd.DataFrame:
    """Every order and step of one part, from its rows by failed set: masks(mask, n, good, toxic), at most 2**m of them."""
    m = len(letters)
    every = (1 << m) - 1
    v, good, toxic = (coalitions(dict(zip(masks["mask"], masks[c], strict=True)), m) for c in ("n", "good", "toxic"))
    total = int(masks["n"].sum())
    shares = [math.factorial(m) * x for x in shapley(v, m)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a sum over all orders is a whole number")
    out = []
    for order in permutations(range(m)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = v[after] - v[before]
            out.append(("".join(letters[j] for j in order), step, total - v[after], removed, v[1 << i] - removed, v[every] - v[every ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], int(shares[i])))
            before = after
    return pd.DataFrame(out, columns=["filter_order", "step", *COUNTS])


def failed_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", failures=text_failures) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters that they fail, bit i for letter i.

    The last letter stands for a text that a smaller id has. Ids and text digests (SHA-256) are combined
    before they meet their text's least id, and meet it by (digest, id), so a text that a third of all
    rows have is spread over its ids.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    conditions = failures(text)
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())), F.lit(0))
    flags = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")), "flags")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = flags.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n")).join(marks, "id", "left")
    first = flags.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    rows = rows.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, F.lit(1 << len(conditions))).otherwise(F.lit(0)))
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", failures=text_failures) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One pass over the texts gives the set of filters that each row fails; rows are counted by part and
    set, at most 2**m a part, and each part's orders, steps and Shapley values follow from the rows that
    every coalition removes. failures(text) gives the conditions by letter; the letter after the last
    of them stands for copies of a text with a smaller id, anywhere in the table.

    Null text is empty; a null part is the empty string. Repeated rows count each, and those of one id
    are no copies of each other. A null id is neither smaller nor larger than others: its row is no copy.
    Labels that repeat an id count as 1 where any of them is 1; null labels and unlabelled rows are
    neither good nor toxic. Extra columns are ignored. An empty table has no parts, so no rows.
    """
    letters = "".join(failures(F.lit("")))
    letters += chr(ord(letters[-1]) + 1)
    sets = failed_sets(docs, labels, id_col, text_col, part_col, failures)

    def steps(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        out = order_steps(masks, letters)
        out.insert(0, "part", key[0])
        return out

    return sets.groupBy("part").applyInPandas(steps, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
