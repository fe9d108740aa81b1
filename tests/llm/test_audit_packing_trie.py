"""The filter audit, the packing and the conversation trie against brute force on small tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import audit, bpe, convtrie, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that must not clash with names used inside.
CLASH = ("id", "part", "mask", "digest", "n", "good", "first", "rank", "length", "key", "at", "conv", "ends", "step", "piece")


def _fails(rows):
    """The failed filters of each row (id, text), as letters."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        hit = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        out.append({x for x, y in zip("ABCDE", hit, strict=True) if y})
    return out


def test_audit_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "", "a b #", "LOUD words", "word " * 120, " ".join(f"w{i}" for i in range(130)), "é　日本 A", "x " * 50 + "$"]
    texts += [" ".join(f"{'W' if rng.random() < 0.2 else 'w'}{x}" for x in rng.integers(0, 300, rng.integers(60, 200))) + ("|" if rng.random() < 0.3 else "") for _ in range(25)]
    texts += [texts[i] for i in rng.integers(0, len(texts), 25)] + ["y " * 200_000]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)] + [(3, "a b #", "de"), (3, "a b #", "de"), (None, "a b #", "de"), (None, None, None)]
    labels = [(0, 1, 0), (3, 1, 1), (3, None, 0), (4, 0, 1), (8, None, 1), (9, 1, None), (None, 1, 1), (777, 1, 1)] + [(i, i % 2, i % 3 == 0) for i in range(10, 50)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in CLASH})
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    fails = _fails([(i, t) for i, t, _ in rows])
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    want, orders = {}, list(itertools.permutations("ABCDE"))
    for part in ("", "de", "en"):
        mine = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        total = collections.Counter()
        for order in orders:
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                earlier = sum(x in f for _, f in mine) - len(gone)
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), earlier, sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in orders:
            for step, x in enumerate(order, 1):
                want[part, "".join(order), step].append(total[x])
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want and len(got) == 1800
    assert all(sum(w[k] for w in want.values()) for k in range(7))


def test_shapley_of_one_and_of_six_filters():
    assert audit.shapley([0, 9], 1) == [9]
    rng = np.random.default_rng(2)
    masks = collections.Counter(rng.integers(0, 64, 300).tolist())
    v = audit.coalitions(masks, 6)
    want = [sum(n * (1 if m >> i & 1 else 0) / m.bit_count() for m, n in masks.items() if m) for i in range(6)]  # a row's filters share it
    assert np.allclose([float(x) for x in audit.shapley(v, 6)], want)


def test_audit_of_an_empty_table(spark):
    assert audit.filter_audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def _placed(plan, counts):
    """Bins of a plan as lists of (offset, length), from every rank of every length."""
    rows = collections.defaultdict(list)
    for length, rank, first, each, offset in plan.rows:
        rows[length].append((rank, first, each, offset))
    bins = collections.defaultdict(list)
    for length in np.flatnonzero(counts).tolist():
        runs = sorted(rows[length])
        for k in range(int(counts[length])):
            rank, first, each, offset = [r for r in runs if r[0] <= k][-1]
            bins[first + (k - rank) // each].append((offset + (k - rank) % each * length, length))
    return bins


@pytest.mark.parametrize(("seed", "groups"), [(1, 2), (2, 7), (3, 40)])
def test_plans_are_gapless_and_near_the_bound(seed, groups):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 200, 300), np.minimum(np.exp(rng.normal(4.6, 0.9, 1500)).astype(int) + 1, 256), np.full(40, 256), np.full(50, 100)])
    counts = np.bincount(lengths, minlength=257)
    plan = packing.pack_counts(counts, 256, groups, 32)
    bins = _placed(plan, counts)
    assert sorted(bins) == list(range(plan.bins))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 256
    # sizes are at most a group's share too large, and one bin a size is left open
    assert plan.bins <= (1.02 + 1 / groups) * -(-int(lengths.sum()) // 256) + groups


def test_groups_have_equal_cardinality_and_the_program_is_optimal():
    counts = np.bincount([70] * 5 + [60] * 5 + [50] * 5 + [40] * 5, minlength=101)
    assert packing.rounded_groups(counts, 4) == [[(70, 5)], [(60, 5)], [(50, 5)], [(40, 5)]]
    assert packing.rounded_groups(counts, 2) == [[(70, 5), (60, 5)], [(50, 5), (40, 5)]]
    assert sum(n for g in packing.rounded_groups(counts, 3) for _, n in g) == 20
    found = packing.configurations([70, 60, 50, 40, 30], [10, 10, 10, 10, 10], 100)
    assert abs(sum(b for _, b in found) - 25) < 1e-6 and all(sum(s * n for s, n in zip([70, 60, 50, 40, 30], c, strict=True)) <= 100 for c, b in found)
    assert packing.cut_pieces(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut_pieces(8, 4) == [(0, 4), (4, 4)] and packing.cut_pieces(4, 4) == [(0, 4)]


def test_packing_matches_the_tokenizer(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " ", "don't stop", "<|endoftext|> x", "日本語 　 テキスト", "a\n\n b", "word " * 5000, "z" * 30_000] + [" ".join(f"t{x}" for x in rng.integers(0, 500, n)) for n in rng.integers(1, 900, 60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "null id"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    got = packing.pack(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")), groups=16).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    want, total = collections.Counter(), 0
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for piece, (start, n) in enumerate(packing.cut_pieces(len(ids), 2048)):
            want[i, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        assert sorted(items) == list(zip(itertools.accumulate([0] + [n for _, n in sorted(items)][:-1]), [n for _, n in sorted(items)], strict=True)) and sum(n for _, n in items) <= 2048
    assert len(bins) <= -(-total // 2048) + 3
    assert packing.pack(bpe.encode(docs.filter("doc_id < 0"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def _trie(rows):
    """Nodes by brute force from (conv, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    built = {c: own.get(c - c % 100, [])[: h(c)] + ts[h(c) :] for c, ts in own.items()}
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), kids[p], leaves[p], saved[p], ends(p)) for p, ms in members.items())


def _run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(7) for c in CLASH})
    convs, turns = convtrie.with_shared_heads(convtrie.number_turns(df))
    nodes = convtrie.prefix_trie(convs, turns)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def test_trie_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 45), *range(201, 215), 300, 302, 407]:  # 200 and 400 are absent
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, "ua"[t % 2], f"{'xyé'[int(rng.integers(0, 2 + (t > 5)))]}"))
    rows += [(300 + k, t, "u", f"long {t}") for k in (3, 5, 9) for t in range(70 if k != 9 else 66)]  # four levels of blocks
    rows += [(500, None, None, None), (500, None, "a", None), (500, 2, "u", "late"), (500, 2, "u", "early"), (500, 2, "u", "early"), (501, 7, None, ""), (None, 1, "u", "no conversation")]
    assert _run(spark, rows) == _trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert _run(spark, []) == []
    alone = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1][:3]  # their base is absent, and their only turn is cut
    rows = [(c, 0, "u", "gone") for c in alone]
    assert _run(spark, rows) == _trie(rows) and len(_trie(rows)) == 1


def test_joined_ids_are_hashed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "CHUNK", 20)
    last = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("ends"), F.col("id").alias("conv"))
    got = {r.ends: r.ends_sha256 for r in convtrie._ends_hash(last).collect()}
    want = collections.defaultdict(list)
    for i in range(3000):
        want["hot" if i < 2500 else f"k{i % 7}"].append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_mixing_takes_ids_of_any_type(spark):
    from siltstone.llm import mixing

    rows = [(f"doc-{i}" if i % 9 else None, "w " * (1 + i % 40) + str(i), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    takes = lambda df: sorted((r.doc_id or "", r.text, r.mix.copies) for r in mixing.mix_sources(df).collect())
    first = takes(docs)
    assert first == takes(docs.repartition(7)) and len(first) == 400
    taken = {s: sum(c * len(t.split()) for d, t, c in first if "ab"[int(t.split()[-1]) % 2] == s) for s in "ab"}
    targets = {r.source: r.mix.target for r in mixing.mix_sources(docs).select("source", "mix").distinct().collect()}
    assert all(abs(taken[s] - targets[s]) < 0.05 * targets[s] for s in "ab")


def test_words_of_a_chunk_keep_their_numbers():
    """Words are cut in one call a block; a chunk numbers each new one, in order, over all of its blocks."""
    kinds, chunk = bpe.classes(), bpe.Chunk()
    for texts in (["a b é a", ""], ["é b\n c"]):
        data = "".join(texts).encode()
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        chunk.add(pa.array(list(range(len(texts)))), bpe.Pieces(np.frombuffer(data, np.uint8), offsets, kinds))
    names = list(chunk.codes)
    assert list(chunk.codes.values()) == list(range(len(names)))
    assert ["".join(names[c] for c in code) for _, _, code in chunk.texts] == ["a b é a", "é b\n c"]
