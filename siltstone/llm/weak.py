"""Quality classifier: a weak-label model by expectation maximisation, and a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import Words, blocks, mix
from siltstone.llm.rules import STATS, block_stats, rule_stats, shares
from siltstone.llm.stored import stored

GOOD, BAD, NONE = 1, 0, -1
WORD_BITS, SHAPE, RECUR = 15, 48, 6
#: So many rows, and about so many letters, are fitted together in a task.
FIT_ROWS, FIT_LETTERS = 4000, 1 << 24
#: Weights are summed over chunks as whole numbers of 2 ** -24, so in any order alike, and in so many slices.
UNIT, SLICES = 1 << 24, 256
#: The cut stands on a scale of so many steps.
STEPS = 1 << 16


def labellers() -> dict:
    """Overlapping heuristics: each votes GOOD, BAD or NONE from a text's statistics."""

    def vote(value, bad, good):
        return F.when(bad(value), BAD).when(good(value), GOOD).otherwise(NONE).cast("int")

    c = F.col
    return {
        "length": vote(c("n_words"), lambda x: x < 50, lambda x: x >= 100),
        "symbols": vote(c("symbols"), lambda x: x > 0.1, lambda x: x < 0.02),
        "repeats": vote(c("repeats"), lambda x: x > 0.3, lambda x: x < 0.1),
        "dup_lines": vote(c("dup_lines"), lambda x: x > 0.3, lambda x: x < 0.1),
        "word_length": vote(c("word_length"), lambda x: (x < 3) | (x > 7), lambda x: (x > 3.5) & (x < 6)),
        "upper": vote(c("upper"), lambda x: x > 0.3, lambda x: x < 0.1),
        "punctuation": vote(c("n_punct") / F.greatest(c("word_chars"), F.lit(1)), lambda x: x > 0.15, lambda x: x < 0.08),
        "odd_words": vote(c("n_odd_words") / F.greatest(c("n_words"), F.lit(1)), lambda x: x > 0.2, lambda x: x < 0.05),
        "sameness": vote(c("sameness"), lambda x: x > 0.2, lambda x: x < 0.1),
    }


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by vote pattern, P(vote | class) by labeller, prior): votes patterns x labellers, counts of rows.

    Starts from one half to the power of the votes for bad; each labeller keeps its own accuracy for good and for bad texts and
    its own rate of having no vote, so that labellers may overlap and differ in worth.
    """
    p = np.clip(0.5 ** (votes == BAD).sum(1), 0.05, 0.95)
    table = np.zeros((votes.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for j in range(votes.shape[1]):
            for v in (NONE, BAD, GOOD):
                table[j, :, v + 1] = weight[:, votes[:, j] == v].sum(1) + 1
        table /= table.sum(2, keepdims=True)
        log = np.log([1 - prior, prior])[:, None] + sum(np.log(table[j][:, votes[:, j] + 1]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        done = np.abs(new - p).max() < tolerance
        p = new
        if done:
            break
    return p, table, prior


def _shape_table() -> np.ndarray:
    """A class for every byte: letters by case, digits, other bytes of ASCII punctuation each, white space, the rest."""
    table = np.full(256, 5, np.int64)
    table[97:123], table[65:91], table[48:58], table[[9, 11, 12, 13, 32]], table[10] = 0, 1, 2, 3, 4
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = 6 + np.arange(len(marks))
    return table


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) entries of three families: runs of three byte classes, hashed lower-case words, and how often each run of three words stands in its text."""
    kind = _shape_table()[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = text[2:] == text[:-2]
    runs = (kind[:-2] * SHAPE + kind[1:-1]) * SHAPE + kind[2:]
    words = Words(data, offsets, lower=True)
    hashed = (words.hash & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64) + SHAPE**3
    h, of = words.hash, words.text
    window = mix(mix(h[:-2] * np.uint64(31) + of[:-2].astype(np.uint64)) * np.uint64(31) + h[1:-1]) * np.uint64(31) + h[2:]
    inside = of[2:] == of[:-2]
    _, at, counts = np.unique(window[inside], return_inverse=True, return_counts=True)
    often = np.minimum(np.log2(counts[at]), RECUR - 1).astype(np.int64) + SHAPE**3 + (1 << WORD_BITS)
    return [(text[:-2][same], runs[same]), (of, hashed), (of[:-2][inside], often)]


def linear_score(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """The scorer's probability for each text; a family's features weigh 1 in all."""
    n = len(offsets) - 1
    x = np.full(n, bias)
    for text, feature in hashed_features(data, offsets):
        x += np.bincount(text, w[feature], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(row: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, size: int, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch Adam; both classes weigh the same in total."""
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    good = target.sum() / len(target)
    weight = np.where(target > 0.5, 0.5 / max(good, 1e-3), 0.5 / max(1 - good, 1e-3)) / len(target)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[feature], minlength=len(target)) + bias, -30, 30)))
        e = (p - target) * weight
        g, gb = np.bincount(feature, value * e[row], minlength=size) + ridge * w / len(target), e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def chunk_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of whole texts; a family's values of a text sum to 1."""
    rows, features, values = [], [], []
    for a, b, data, offsets in blocks(texts):
        for text, feature in hashed_features(data, offsets):
            pair, times = np.unique(text.astype(np.int64) << 18 | feature, return_counts=True)
            row = pair >> 18
            rows.append(row + a)
            features.append(pair & ((1 << 18) - 1))
            values.append(times / np.bincount(text, minlength=b - a)[row])
    return np.concatenate(rows), np.concatenate(features), np.concatenate(values)


def fit_everywhere(rows: DataFrame, targets: DataFrame, chunks: int, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear scorer, fitted on all n of rows(key long, text) whose key has one of targets(key, target).

    Rows and targets are dealt by key to chunks, whatever files they come from. Each chunk is fitted in one task, and
    the chunks' weights are averaged, each by its number of rows; one chunk alone is fit_linear() itself.
    """
    size = SHAPE**3 + (1 << WORD_BITS) + RECUR
    edges = np.linspace(0, size + 1, SLICES + 1).astype(int)

    def sliced(total):
        parts = [total[a:b].astype("<i8").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "total"])

    def solve(texts, targets):
        keys, first = np.unique(targets["key"].to_numpy(), return_index=True)
        texts = texts.sort_by("key")
        texts = texts.filter(np.isin(texts["key"].to_numpy(), keys))
        if not len(texts):
            return sliced(np.zeros(size + 1, np.int64))
        target = targets["target"].to_numpy()[first][np.searchsorted(keys, texts["key"].to_numpy())]
        w, bias = fit_linear(*chunk_features(texts["text"].combine_chunks()), target, size)
        return sliced(np.rint(np.append(w, bias) * len(texts) * UNIT).astype(np.int64))

    def add(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for k, part in zip(batch["slice"].to_pylist(), batch["total"].to_pylist(), strict=True):
                total[edges[k] : edges[k + 1]] += np.frombuffer(part, "<i8")
        yield from sliced(total).to_batches()

    def join(table):
        total = sum(np.frombuffer(part, "<i8") for part in table["total"].to_pylist())
        return pa.table([table["slice"][:1], pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["slice", "total"])

    if not n:
        return np.zeros(size), 0.0
    form = "slice int, total binary"
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, chunks)  # by bytes they would be few
    dealt = lambda df: df.withColumn("chunk", F.pmod("key", F.lit(chunks))).repartition(tasks, "chunk").groupBy("chunk")
    summed = dealt(rows).cogroup(dealt(targets)).applyInArrow(solve, form).mapInArrow(add, form).groupBy("slice").applyInArrow(join, form)
    found = {r.slice: np.frombuffer(bytes(r.total), "<i8") for r in summed.collect()}  # one vector of weights
    w = np.concatenate([found[k] for k in range(SLICES)]) / (n * UNIT)
    return w[:-1], float(w[-1])


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, good_kept: float = 0.995) -> DataFrame:
    """(id, votes array<int>, posterior, score, kept) of every row.

    Overlapping heuristic labellers vote on every whole text. The counts of vote patterns over all
    rows (at most 3 ** labellers of them, so they may meet on the driver) give, by expectation
    maximisation, each labeller's accuracies and each pattern's posterior of being good. A linear
    scorer over hashed features is trained on the posteriors of all rows with a word, about fit_rows of
    them at a time (see fit_everywhere()); score is its probability for the whole text. kept: the score
    reaches 0.5, or a lower level that keeps good_kept of all rows with a word and a posterior over 0.9.

    Null and empty texts have no features: their score comes from the bias alone and kept is false.
    Repeated rows each get theirs. Extra columns are ignored. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    votes = F.array(*labellers().values())
    # the key tells rows apart by what they hold, so that chunks are the same in every run
    keyed = docs.select(F.xxhash64("id", "text").alias("key"), "text")
    voted = stored(rule_stats(keyed, "key", "text").withColumns(shares()).select("key", "n_words", "word_chars", votes.alias("votes")), "votes")
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n"), F.count_if(F.col("n_words") > 0).alias("m"), F.sum("word_chars").alias("letters")).orderBy("votes").collect()  # 3 ** labellers at most
    cast = np.array([r.votes for r in patterns], np.int64).reshape(-1, len(labellers()))
    posterior = np.zeros(0)
    if patterns:
        posterior, _, _ = expectation_maximisation(cast, np.array([r.n for r in patterns], float))
    known = {tuple(v): float(p) for v, p in zip(cast.tolist(), posterior, strict=True)}
    table = docs.sparkSession.createDataFrame([([int(x) for x in v], p) for v, p in known.items()], "votes array<int>, posterior double")
    kind = docs.schema["id"].dataType.simpleString()
    measured = ", ".join(f"{c} long" for c in STATS)

    n = sum(r.m for r in patterns)
    chunks = max(-(-n // fit_rows), -(-sum(r.letters or 0 for r in patterns) // FIT_LETTERS), 1)
    targets = voted.filter("n_words > 0").join(F.broadcast(table), "votes").select("key", F.col("posterior").alias("target"))
    model = docs.sparkSession.sparkContext.broadcast(fit_everywhere(keyed.filter("text IS NOT NULL"), targets, chunks, n))

    def score(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                stats = [pa.array(np.asarray(c, np.int64)) for c in block_stats(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *stats, pa.array(linear_score(data, offsets, *model.value))], names=["id", *STATS, "score"])

    scored = docs.mapInArrow(score, f"id {kind}, {measured}, score double").withColumns(shares()).withColumn("votes", votes)
    scored = stored(scored.join(F.broadcast(table), "votes", "left").select("id", "votes", "posterior", "score", "n_words"), "scores")
    steps = scored.filter("n_words > 0 AND posterior > 0.9").groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()  # STEPS + 1 at most
    lost, cut = (1 - good_kept) * sum(r.n for r in steps), 0.5
    for r in steps:
        lost -= r.n
        if lost < 0:
            cut = min(0.5, r.step / STEPS)
            break
    return scored.select(F.col("id").alias(id_col), "votes", "posterior", "score", ((F.col("score") >= cut) & (F.col("n_words") > 0)).alias("kept"))
