"""Language ID: scripts narrow the candidates, Viterbi over word scores labels the spans."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import Hasher, blocks, mix, text_of

#: Hashed features; a model has this many scores a language, whatever the corpus.
FEATURE_BITS, PART_BITS = 16, 12
#: The cost of a change of language between two words, in nats.
SWITCH = 12.0
#: Ranges of code points and the script that they belong to.
SCRIPTS = (
    (0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xAA, 0xAA, "Latin"), (0xBA, 0xBA, "Latin"), (0xC0, 0x24F, "Latin"), (0x1E00, 0x1EFF, "Latin"),
    (0x370, 0x3FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x530, 0x58F, "Armenian"), (0x590, 0x5FF, "Hebrew"),
    (0x600, 0x6FF, "Arabic"), (0x750, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xA00, 0xA7F, "Gurmukhi"),
    (0xA80, 0xAFF, "Gujarati"), (0xB80, 0xBFF, "Tamil"), (0xC00, 0xC7F, "Telugu"), (0xC80, 0xCFF, "Kannada"), (0xD00, 0xD7F, "Malayalam"),
    (0xE00, 0xE7F, "Thai"), (0xE80, 0xEFF, "Lao"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0xAC00, 0xD7A3, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x3040, 0x309F, "Kana"), (0x30A0, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0x20000, 0x323AF, "Han"),
)
NAMES = ("none", "other", *dict.fromkeys(s for *_, s in SCRIPTS))


def script_table() -> np.ndarray:
    """The script of every code point: 0 for what isn't a letter."""
    table = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), np.uint8, 0x110000)
    for a, b, name in SCRIPTS:
        part = table[a : b + 1]
        part[part > 0] = NAMES.index(name)
    return table


class LetterWords:
    """The words (runs of letters) of one block of texts: text, length, script, and hashed features in a row.

    Features of a word: itself, and each run of three code points of the word with one blank around it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, scripts: np.ndarray):
        text = data.tobytes().decode()
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) != len(raw):  # a few letters grow in lower case
            points = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in raw], np.uint32)
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        script = scripts[points]
        letter = script > 0
        cut = np.zeros(len(points) + 1, bool)
        cut[offsets] = True
        begin, finish = letter.copy(), letter.copy()
        begin[1:] &= ~letter[:-1] | cut[1:-1]
        finish[:-1] &= ~letter[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.size = self.end - self.start
        self.text = text_of(offsets, self.start)
        self.script = script[self.start]
        mask = np.uint64((1 << FEATURE_BITS) - 1)
        self.whole = (Hasher(points)(self.start, self.end) & mask).astype(np.int64)
        # letters with a zero on both sides of each word, then runs of three
        at = np.flatnonzero(letter)
        word = np.repeat(np.arange(len(self.size)), self.size)
        padded = np.zeros(len(at) + 2 * len(self.size), np.uint64)
        padded[np.arange(len(at)) + 2 * word + 1] = points[at]
        if len(padded):
            g = mix((padded[:-2] * np.uint64(0x110000) + padded[1:-1]) * np.uint64(0x110000) + padded[2:] + np.uint64(1))
            inner = np.flatnonzero(padded[1:-1] > 0)  # one run around each letter
            self.grams = (g[inner] & mask).astype(np.int64)
        else:
            self.grams = np.zeros(0, np.int64)
        self.word = word
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The labels of the best path through scores (words x languages) where each change costs `switch`.

    The walk word by word is left out where no path beats the overall best language. A path of k runs
    in other languages pays k changes if it uses the best one too: no run may gain more than one change
    costs. Without it, it pays k - 1: then no run may gain more than half of that (k / 2 <= k - 1), or
    the sum of every word's best other language may not gain more than one change.
    """
    best = int(np.argmax(scores.sum(0)))
    more = scores - scores[:, best : best + 1]
    gain = np.cumsum(more, 0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, scores.shape[1])), gain[:-1]]), 0)
    most = (gain - low).max()
    if most <= switch:
        more[:, best] = -np.inf
        if most <= switch / 2 or more.max(1).sum() <= switch:
            return np.full(len(scores), best)
    n, k = scores.shape
    back = np.empty((n, k), np.int32)
    now, same = np.zeros(k), np.arange(k)
    for i in range(n):
        top = int(np.argmax(now))
        change = now[top] - switch > now
        back[i] = np.where(change, top, same)
        now = np.where(change, now[top] - switch, now) + scores[i]
    out = np.empty(n, np.int64)
    out[-1] = int(np.argmax(now))
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


class Model:
    """Word scores by language: log probabilities of hashed features, and the scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, least_share: float = 0.005):
        self.langs = langs
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32).T.copy() if len(langs) else np.zeros((1 << FEATURE_BITS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.uses = share >= least_share
        self.uses[:, ~self.uses.any(0)] = True  # a script that no language is known for narrows nothing

    def word_scores(self, w: LetterWords) -> np.ndarray:
        k = len(self.langs)
        total = np.stack([np.bincount(w.word, self.log[w.grams, i], minlength=len(w.size)) for i in range(k)], 1)
        score = total / np.sqrt(np.maximum(w.size, 1))[:, None] + self.log[w.whole]  # runs overlap, so they count less each
        score -= score.max(1, keepdims=True)
        score = np.maximum(score, -8.0)
        score[~self.uses.T[w.script]] = -50.0
        return score


def _counts(docs: DataFrame, langs: list[str], scripts) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and letters by script of every language, over all texts of docs(lang, text)."""
    place = {x: i for i, x in enumerate(langs)}
    size, part = 1 << FEATURE_BITS, 1 << PART_BITS

    def run(batches):
        table = scripts.value
        total, letters = np.zeros((len(langs), size), np.int64), np.zeros((len(langs), len(NAMES)), np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b, data, offsets in blocks(batch.column(1)):
                w = LetterWords(data, offsets, table)
                of = lang[a:b][w.text]
                for i in np.unique(of):
                    mine = of == i
                    total[i] += np.bincount(w.grams[mine[w.word]], minlength=size) + np.bincount(w.whole[mine], minlength=size)
                    letters[i] += np.bincount(w.script[mine], w.size[mine], minlength=len(NAMES)).astype(np.int64)
        rows = [(i, p, total[i, p * part : (p + 1) * part]) for i in range(len(langs)) for p in range(size // part)] + [(i, -1, letters[i]) for i in range(len(langs))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))], names=["lang", "part", "counts"])

    def total(batches):
        kept: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for i, p, c in zip(pdf["lang"], pdf["part"], pdf["counts"], strict=True):
                kept[i, p] = kept.get((i, p), 0) + np.asarray(c)
        yield pd.DataFrame([(*k, c.tolist()) for k, c in kept.items()], columns=["lang", "part", "counts"])

    made = docs.mapInArrow(run, "lang int, part int, counts array<bigint>").repartition(F.col("lang"), F.col("part")).mapInPandas(total, "lang int, part int, counts array<bigint>")
    counts, letters = np.zeros((len(langs), size)), np.zeros((len(langs), len(NAMES)))
    for r in made.collect():  # a model's fixed size
        if r.part < 0:
            letters[r.lang] += r.counts
        else:
            counts[r.lang, r.part * part : (r.part + 1) * part] += r.counts
    return counts, letters


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_langs: int = 500) -> Model:
    """A model of all languages in lang_col; rows with null text or language teach nothing."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = [r.lang for r in known.select("lang").distinct().orderBy("lang").limit(most_langs + 1).collect()]
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not langs:
        return Model([], np.zeros((0, 1 << FEATURE_BITS)), np.zeros((0, len(NAMES))))
    return Model(langs, *_counts(known, langs, docs.sparkSession.sparkContext.broadcast(script_table())))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(id, lang_pred, score, spans) of every row's whole text.

    Words are runs of letters. A word's script leaves the languages that use it; its score for these
    is the log probability of its hashed features. Viterbi with a cost for every change labels the
    words; spans are the runs of one language in order, as (lang, n_words). lang_pred is the language
    with the most letters, score its share of them; `und` and 0 where the text is null or has no
    letter, or the model knows no language. Repeated rows and null ids each get their row. Extra
    columns are ignored. An empty table gives an empty one.
    """
    scripts, model = docs.sparkSession.sparkContext.broadcast(script_table()), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table, m = scripts.value, model.value
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                w = LetterWords(data, offsets, table)
                pred, score, spans = ["und"] * (b - a), [0.0] * (b - a), [[] for _ in range(b - a)]
                scores = m.word_scores(w) if m.langs and len(w.size) else None
                for t in range(b - a) if scores is not None else ():
                    x, y = w.first[t], w.first[t + 1]
                    if x == y:
                        continue
                    labels = viterbi(scores[x:y], switch)
                    letters = np.bincount(labels, w.size[x:y], minlength=len(m.langs))
                    best = int(np.argmax(letters))
                    pred[t], score[t] = m.langs[best], float(letters[best] / letters.sum())
                    cuts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
                    spans[t] = [{"lang": m.langs[labels[c]], "n_words": int(n)} for c, n in zip(cuts, np.diff(np.append(cuts, y - x)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())])))], names=["id", "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, spans array<struct<lang: string, n_words: bigint>>").withColumnRenamed("id", id_col)
