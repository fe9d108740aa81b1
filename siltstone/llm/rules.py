"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import Words, blocks, mix, spans, text_of
from siltstone.llm.stored import stored

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
PUNCT = np.zeros(256, bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_punct", "n_odd_words")
#: What the forest sees, each on the scale of `scaled`.
FEATURES = ("symbols", "dup_lines", "repeats", "word_length", "upper", "sameness")
TREES, LEAF_SAMPLE = 100, 256
BINS = 400
#: The least distance from a share's middle to its usual level that counts as one step beyond it.
LEAST_STEP = 0.02


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each text inside a 3-word window that stands twice or more in it."""
    h, n = words.hash, len(words.hash)
    out = np.zeros(words.n, np.int64)
    if n < 3:
        return out
    same = words.text[:-2] == words.text[2:]
    k = np.uint64(0x9E3779B97F4A7C15)
    window = mix(mix(mix(h[:-2] * k + words.text[:-2].astype(np.uint64)) * k + h[1:-1]) * k + h[2:])
    at = np.flatnonzero(same)
    order = np.argsort(window[at], kind="stable")
    w = window[at][order]
    twin = np.zeros(len(w), bool)
    equal = w[1:] == w[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[at[order[twin]] + i] = True
    return np.bincount(words.text[covered], minlength=words.n)


def _distinct(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each text has, and how many of its values equal an earlier one."""
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    again = np.zeros(len(t), bool)
    again[1:] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
    return np.bincount(t[~again], minlength=n), np.bincount(t[again], minlength=n)


def block_stats(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = Words(data, offsets)
    n = words.n
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(words.text, points[words.end] - points[words.start], minlength=n).astype(np.int64)
    count = lambda marks: np.bincount(text_of(offsets, np.flatnonzero(marks)), minlength=n)
    start, end = spans(data, offsets, data == 10)
    line = text_of(offsets, start)
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)  # lines that hold a word
    start, end, line = start[full], end[full], line[full]
    _, dup = _distinct(line, words.hasher(start, end), n)
    variety, _ = _distinct(words.text, words.hash, n)
    marks = np.concatenate([[0], np.cumsum(PUNCT[data])])
    odd = np.bincount(words.text[marks[words.end] - marks[words.start] > 1], minlength=n)
    return [words.count, chars, count(SYMBOL[data]), dup, _repeat_words(words), np.bincount(line, minlength=n), count(UPPER[data]), variety, count(PUNCT[data]), odd]


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATS...) of every whole text, in one Arrow pass; null text counts as empty."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                cols = block_stats(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(np.asarray(c, np.int64)) for c in cols]], names=[id_col, *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in STATS))


def shares() -> dict:
    """FEATURES as columns: shares that don't grow with the text."""
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "upper": F.col("n_upper") / chars,
        "sameness": 1 - F.log1p(F.col("n_distinct")) / F.log1p(words),
    }


class Scale:
    """Each share from 0 to 2: what labelled good rows show, from their least to their usual level, fills 0 to 1 evenly;
    beyond it a share nears 2, halfway there when it is as far from the usual level as that is from the middle."""

    def __init__(self, least: np.ndarray, middle: np.ndarray, usual: np.ndarray):
        self.least, self.usual = least, usual
        self.step = np.maximum(usual - middle, LEAST_STEP)

    def __call__(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = np.stack([np.asarray(columns[c], np.float64) for c in FEATURES], 1)
        over = np.maximum(x - self.usual, 0.0)
        return np.clip((x - self.least) / np.maximum(self.usual - self.least, 1e-9), 0.0, 1.0) + over / (over + self.step)


class Forest:
    """Random splits; a row's score is 2 ** -(mean path length / the mean over random data), high for the odd.

    Splits fall anywhere in a node's box, in the parts that hold none of the rows too: what lies there is set apart
    after few splits, however near to the outermost row.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = LEAF_SAMPLE, seed: int = 7, tree: np.ndarray | None = None, box: tuple[float, float] | None = None):
        """tree: the tree that each row was drawn for; without it every tree draws from all rows. box: the bounds
        of every column, by default those of the rows."""
        rng = np.random.default_rng(seed)
        self.box = tuple(np.full(rows.shape[1], x) for x in box) if box else (rows.min(0), rows.max(0)) if len(rows) else None
        drawn = [rows[rng.permutation(len(rows))[:sample]] if tree is None else rows[tree == t][:sample] for t in range(trees)] if len(rows) else []
        self.size = min((len(d) for d in drawn), default=0)
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = [self._grow(d[: self.size], rng) for d in drawn]

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, at, left, length = [], [], [], []
        todo = [(rows, 0, *self.box)]
        place = 0
        while place < len(todo):  # breadth first, children side by side
            part, depth, low, high = todo[place]
            place += 1
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) < 2 or not len(wide):
                feature.append(-1), at.append(0.0), left.append(0), length.append(depth + mean_path(len(part)))
                continue
            k = rng.choice(wide)
            x = rng.uniform(low[k], high[k])
            feature.append(k), at.append(x), left.append(len(todo)), length.append(0.0)
            below, above = high.copy(), low.copy()
            below[k] = above[k] = x
            todo += [(part[part[:, k] < x], depth + 1, low, below), (part[part[:, k] >= x], depth + 1, above, high)]
        return np.array(feature), np.array(at), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(rows), 0.5)
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, at, left, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, left[node] + (rows[every, np.maximum(f, 0)] >= at[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.size), 1e-9))


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Judge:
    """What fitting leaves: the scale, the forest and the threshold, and the base rules' bounds."""

    def __init__(self, scale: Scale, forest: Forest, cut: float, min_words: int, repeat_percent: int):
        self.scale, self.forest, self.cut, self.min_words, self.repeat_percent = scale, forest, cut, min_words, repeat_percent

    def score(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return self.forest.score(self.scale(columns))

    def base_failed(self):
        return (F.col("n_words") < self.min_words) | (100 * F.col("n_repeat_words") > self.repeat_percent * F.col("n_words"))


def fit_judge(stats: DataFrame, labels: DataFrame, id_col: str, min_words: int, repeat_percent: int, trees: int = TREES, sample: int = LEAF_SAMPLE, usual_share: float = 0.999, good_kept: float = 0.99) -> Judge:
    """A judge from the stored statistics of all rows and the labelled rows; see quality_rules."""
    none = np.zeros(len(FEATURES))
    judge = Judge(Scale(none, none, none), Forest(np.zeros((0, len(FEATURES)))), 2.0, min_words, repeat_percent)
    passed = stats.filter(~judge.base_failed() & F.col(id_col).isNotNull())
    marked = labels.filter("quality IS NOT NULL").groupBy(id_col).agg(F.min("quality").alias("quality"))
    levels = lambda df: df.agg(*[F.percentile_approx(c, [0.0, 0.5, usual_share], 100_000) for c in FEATURES]).first()
    model = passed.join(marked.filter("quality = 1").select(id_col), id_col)
    found = levels(model)
    if found[0] is None:
        model, found = passed, levels(passed)
    judge.scale = Scale(*np.array([x or (0.0,) * 3 for x in found]).T)
    judge.forest = Forest(*drawn_rows(model, judge.scale, id_col, trees, sample), box=(0.0, 2.0))
    scored = with_scores(passed, judge)
    bins = scored.join(marked, id_col).groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    judge.cut = threshold({r.bin: (r.good, r.bad) for r in bins.collect()}, good_kept)  # BINS + 1 rows at most
    return judge


def drawn_rows(model: DataFrame, scale: Scale, id_col: str, trees: int, sample: int) -> tuple:
    """The arguments of a forest whose trees draw their own rows from all of model.

    A hash of each row says whether it is drawn and for which tree; the share is set so that a tree expects
    twice the rows that it takes, the least by hash. At most about 2 * trees * sample rows are drawn. Where
    there are no more than that in all, each tree draws from all of them.
    """
    n, most = model.count(), 2 * trees * sample
    h = F.xxhash64(F.lit("forest"), id_col, *FEATURES)
    rows = model.select(*FEATURES, h.alias("_h"))
    if n > most:
        rows = rows.filter(F.pmod(F.shiftrightunsigned("_h", 8), F.lit(1 << 40)) < int((1 << 40) * most / n))
    fit = rows.toPandas().sort_values(["_h", *FEATURES], kind="stable")
    points = scale({c: fit[c] for c in FEATURES})
    return points, trees, sample, 7, (fit["_h"].to_numpy() % trees if n > most else None)


def with_scores(stats: DataFrame, judge: Judge) -> DataFrame:
    def run(batches):
        for batch in batches:
            score = judge.score({c: batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return stats.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + ", score double")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, repeat_percent: int = 50, **fit) -> DataFrame:
    """(id, STATS..., FEATURES..., base_failed, score, kept) of every row of docs.

    base_failed: under min_words words, or over repeat_percent of the words in repeated windows. An
    isolation forest is grown on labelled good rows (labels: id, quality; on all rows that pass the base
    where none is labelled good): each of its trees draws `sample` of them, so that at most about
    2 * trees * sample labelled rows shape it. A share's scale runs from the least of these rows over its
    usual_share quantile to beyond (Scale), and splits fall anywhere on it, so that a row leaves the good
    ones sooner the farther beyond it lies, and the rarer its shares are together. A row's
    score comes from its mean path length. The threshold is the
    score that best parts good from bad labelled rows among those that keep good_kept of the good;
    every labelled row counts, in a histogram of BINS bins. Without labels of both kinds nothing is
    rejected beyond the base. kept: not base_failed, and a score under the threshold.

    Null and empty text: no words, base_failed. Null ids get a verdict too, but fit and calibrate
    nothing. Repeated rows each get their row. Extra columns are ignored. Empty table: empty result.
    """
    stats = stored(rule_stats(docs, id_col, text_col).withColumns(shares()), "rules")
    judge = fit_judge(stats, labels, id_col, min_words, repeat_percent, **fit)
    scored = with_scores(stats, judge).withColumn("base_failed", judge.base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < judge.cut))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, repeat_percent: int = 50, **fit) -> DataFrame:
    """The rows of docs that quality_rules keeps, judged where they are read, so that no text is shuffled."""
    stats = stored(rule_stats(docs, id_col, text_col).withColumns(shares()), "rules")
    judge = fit_judge(stats, labels, id_col, min_words, repeat_percent, **fit)
    text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(text)):
                s = dict(zip(STATS, block_stats(data, offsets), strict=True))
                words, lines, chars = (np.maximum(s[c], 1) for c in ("n_words", "n_lines", "word_chars"))
                shown = {"symbols": s["n_symbols"] / words, "dup_lines": s["n_dup_lines"] / lines, "repeats": s["n_repeat_words"] / words, "word_length": s["word_chars"] / words, "upper": s["n_upper"] / chars, "sameness": 1 - np.log1p(s["n_distinct"]) / np.log1p(words)}
                kept = (s["n_words"] >= min_words) & (100 * s["n_repeat_words"] <= repeat_percent * s["n_words"]) & (judge.score(shown) < judge.cut)
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def threshold(bins: dict[int, tuple[int, int]], good_kept: float) -> float:
    """The score from which rows are rejected: halfway from the lowest bin it must catch to the next good one below; 2 rejects nothing."""
    good, bad = sum(g for g, _ in bins.values()), sum(b for _, b in bins.values())
    best, cut, lost, caught = 0.0, 2.0, 0, 0
    if not good or not bad:
        return cut
    for b in sorted(bins, reverse=True):
        lost, caught = lost + bins[b][0], caught + bins[b][1]
        if lost > (1 - good_kept) * good:
            break
        if caught / bad - lost / good > best:
            best, cut = caught / bad - lost / good, b
    below = [b for b in bins if cut != 2.0 and b < cut and bins[b][0]]
    return 2.0 if cut == 2.0 else (cut + (max(below) + 1 if below else 0)) / 2 / BINS
