"""Byte-level BPE over a global shuffle of distinct words, gathered by chunks of texts."""

from __future__ import annotations

import base64
import codecs
import unicodedata
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from siltstone.llm.bytetext import Hasher, blocks, mix

#: A chunk of a task's texts ends with so many letters or different pre-tokens.
CHUNK, GATHER = 1 << 22, 200_000
#: Bytes of text at a time, small enough for the caches.
BLOCK = 1 << 19
#: Words of a bucket whose ids are held at a time.
KEPT = 1_000_000
#: What a row of a chunk holds.
WORDS, PLAN, TEXTS = range(3)
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points with the Unicode property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    kinds[list(WHITE)] = SPACE
    return kinds


def pre_tokens(points: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of a run of texts; offsets: where texts start, and the end.

    The same pieces as the usual pattern: 's 't 're 've 'm 'll 'd | one blank and letters | one blank
    and numbers | one blank and others | white space but for the last before a word | white space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    head = np.zeros(n + 4, bool)
    head[offsets] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])  # the last white space before a word
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    at = np.flatnonzero((points == 0x27) & start)
    follow = np.concatenate([points, np.zeros(3, points.dtype)])
    one, two = np.where(head[at + 1], 0, follow[at + 1]), np.where(head[at + 1] | head[at + 2], 0, follow[at + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    start[at[short | long] + 1] = False
    behind = np.concatenate([at[short] + 2, at[long] + 3])
    start[behind[behind < n]] = True
    return np.flatnonzero(start)


#: A fixed value: the pattern that pre_tokens follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pieces:
    """The pre-tokens of one block of texts: start, end, hash, and the first piece of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
        self.text = data.tobytes().decode()
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        self.start = pre_tokens(points, offsets, kinds)
        self.end = np.append(self.start[1:], len(points)) if len(points) else self.start
        self.hasher = Hasher(points)
        self.hash = self.hasher(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)

    def words(self, at) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each different piece, which of these each piece is): equal hashes are held against the letters."""
        _, at, which = np.unique(self.hash, return_index=True, return_inverse=True)
        if not self.hasher.same(self.start[at][which], self.start, self.end - self.start):
            seen = defaultdict(count().__next__)
            which = np.array([seen[w] for w in self.words(slice(None))])
            at = np.unique(which, return_index=True)[1]
        return at, which


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes, low bytes first: the mostly zero high ones pack to little."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Packer:
    """Packs counts and bytes into one value and back."""

    def __init__(self):
        self.press, self.open = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

    def dump(self, counts: np.ndarray, data: bytes) -> bytes:
        return len(counts).to_bytes(4, "little") + self.press(planes(counts) + data)

    def load(self, blob: bytes) -> tuple[np.ndarray, bytes]:
        n, data = 4 * int.from_bytes(blob[:4], "little"), self.open(blob[4:])
        return from_planes(data[:n]), data[n:]


class Chunk:
    """A run of whole texts of one task: a dictionary of its different words, and the texts as places in it."""

    def __init__(self):
        self.codes: dict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.hashes: list[np.ndarray] = []
        self.texts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: pa.Array, p: Pieces) -> None:
        at, which = p.distinct()
        known = len(self.codes)
        code = np.fromiter(map(self.codes.__getitem__, p.words(at)), np.int64, len(at))
        fresh = np.unique(code, return_index=True)
        self.hashes.append(p.hash[at[fresh[1][fresh[0] >= known]]])
        self.texts.append((ids, np.diff(p.first), (code[which] if len(at) else which).astype(np.int32)))
        self.size += len(p.text)

    def rows(self, name: int, buckets: int, packer: Packer):
        """(key, kind, at, ids, blob): the words of each bucket, by the bucket; the plan of the dictionary and the texts, by the chunk.

        Words are numbered by how often the chunk has them, and stand in this order within their bucket.
        """
        words = list(self.codes)
        often = np.bincount(np.concatenate([t[2] for t in self.texts]), minlength=len(words)) if words else np.zeros(0, np.int64)
        order = np.argsort(-often, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        hashes = np.concatenate([*self.hashes, np.zeros(0, np.uint64)])[order]
        bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        column = pa.array([words[i] for i in order[by].tolist()], pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(words) + 1) if words else np.zeros(1, np.int64)
        data = column.buffers()[2].to_pybytes() if words else b""
        found, cuts = np.unique(bucket[by], return_index=True)
        for b, x, y in zip(found.tolist(), cuts, [*cuts[1:], len(words)], strict=False):
            yield b, WORDS, name, None, packer.dump(np.diff(offsets[x : y + 1]), data[offsets[x] : offsets[y]])
        yield name, PLAN, 0, None, packer.dump(bucket, np.add.reduceat(hashes[by], cuts).tobytes() if words else b"")
        for i, (ids, counts, code) in enumerate(self.texts):
            yield name, TEXTS, i, ids, packer.dump(counts, planes(number[code]))


def chunk_rows(docs: DataFrame, kinds, buckets: int, block: int = BLOCK) -> DataFrame:
    """(key, kind, at, ids, blob): every task's texts in chunks of about CHUNK letters; docs(id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        packer, n, chunk, id_type = Packer(), 0, Chunk(), None

        def batch_of(chunk):
            name = (1 << 62) + (TaskContext.get().partitionId() << 24) + n
            rows = list(chunk.rows(name, buckets, packer))
            sizes = np.array([0 if r[3] is None else len(r[3]) for r in rows])
            every = pa.concat_arrays([pa.array([], id_type), *(r[3] for r in rows if r[3] is not None)])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), every)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), ids, pa.array([r[4] for r in rows], pa.binary())], names=["key", "kind", "at", "ids", "blob"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for a, b, data, offsets in blocks(batch.column(1), block):
                chunk.add(batch.column(0).slice(a, b - a), Pieces(data, offsets, kinds.value))
                if chunk.size > CHUNK or len(chunk.codes) > GATHER:
                    yield batch_of(chunk)
                    chunk, n = Chunk(), n + 1
        if chunk.texts:
            yield batch_of(chunk)

    return docs.select("id", "text").mapInArrow(run, f"key long, kind int, at long, ids array<{kind}>, blob binary")


def rank_encoder(ranks):
    """Words to ids by a table of ranks (broadcast)."""

    def start():
        merges = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        return lambda words: (merges.encode_ordinary(w.decode()) for w in words)

    return start


def json_encoder(model):
    """Words to ids by a byte-level BPE file of the tokenizers library (broadcast as text). Its model takes the words as they are: no pattern is matched again, and special tokens' strings are ordinary text."""

    def start():
        merge = Tokenizer.from_str(model.value).model.tokenize
        # bytes that are printable stand for themselves, the others in order for the alphabet's further letters
        alphabet = sorted(map(ord, ByteLevel.alphabet()))
        own = {c for c in alphabet if c < 256}
        further = iter([c for c in alphabet if c >= 256])
        letters = "".join(chr(b if b in own else next(further)) for b in range(256))
        return lambda words: ([x.id for x in merge(codecs.charmap_decode(w, "strict", letters)[0])] for w in words)

    return start


def encode_words(rows: DataFrame, encoder) -> DataFrame:
    """(key, at, check, blob) for each chunk and bucket: the ids of the bucket's words in the chunk's order. rows: chunk_rows, buckets together.

    A word is merged once for all chunks; the table of words is of one bucket only, and is begun anew if it outgrows KEPT.
    A pre-token is one match of the pattern when it stands alone too, so encoding it as a text gives its merges.
    """

    def run(batches):
        merge = encoder()
        packer, now, known = Packer(), None, {}

        def ids_of(words: list[bytes]) -> list[bytes]:
            found = list(map(known.get, words))
            fresh = list({w for w, x in zip(words, found, strict=True) if x is None})
            if not fresh:
                return found
            if len(known) + len(fresh) > KEPT:
                known.clear()
                fresh = list(set(words))
            known.update((w, array("I", x).tobytes()) for w, x in zip(fresh, merge(fresh), strict=True))
            return [known[w] for w in words]

        for batch in batches:
            out = []
            for key, kind, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "at", "blob")), strict=True):
                if kind != WORDS:
                    continue
                if key != now:
                    now, known = key, {}
                sizes, data = packer.load(blob)
                ends = np.cumsum(sizes)
                ids = ids_of([data[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
                points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
                cuts = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[np.concatenate([[0], ends])]
                check = Hasher(points)(cuts[:-1], cuts[1:]).sum(dtype=np.uint64).astype(np.int64)
                out.append((chunk, key, int(check), packer.dump(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, planes(np.frombuffer(b"".join(ids), "<u4")))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in out], pa.binary())], names=["key", "at", "check", "blob"])

    return rows.sortWithinPartitions("key", "at").mapInArrow(run, "key long, at long, check long, blob binary")


def _filled(texts: pa.Table, words: pa.Table, schema: pa.Schema, packer: Packer) -> pa.Table:
    """(id, ids) of a chunk's texts, from its plan and its words' ids."""
    rows = {(k, a): (i, blob) for i, (k, a, blob) in enumerate(zip(*(texts.column(c).to_pylist() for c in ("kind", "at", "blob")), strict=True))}
    if (PLAN, 0) not in rows:
        return schema.empty_table()
    bucket, checks = packer.load(rows[PLAN, 0][1])
    made = sorted(zip(*(words.column(c).to_pylist() for c in ("at", "check", "blob")), strict=True))
    if [r[1] for r in made] != np.frombuffer(checks, np.int64).tolist():
        raise RuntimeError("a chunk was made twice from different rows: give encode() a table that reads the same each time")
    loaded = [packer.load(r[2]) for r in made]
    flat = np.concatenate([np.zeros(0, np.int64), *(from_planes(x[1]) for x in loaded)]).astype("<u4")
    sizes = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in loaded)])
    by = np.argsort(bucket, kind="stable")
    size, begin = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    size[by], begin[by] = sizes, np.cumsum(sizes) - sizes
    out = []
    for i, blob in (rows[r] for r in sorted(rows) if r[0] == TEXTS):
        counts, data = packer.load(blob)
        code = from_planes(data)
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[code] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = 4 * ends[np.concatenate([[0], np.cumsum(counts)])]
        column = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
        out.append(pa.Table.from_arrays([texts.column("ids").slice(i, 1).combine_chunks().flatten(), column], schema=schema))
    return pa.concat_tables(out)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, ids) of every row: the token ids of the whole text as little-endian unsigned 32-bit integers.

    Every task cuts its texts into pre-tokens and gathers the different ones of each chunk of texts; a
    text becomes the places of its words in the chunk's dictionary. The dictionaries meet by word, in
    buckets of a word's hash, where each distinct word is merged once for all chunks; its ids go back
    to every chunk that has it and are put into its texts by position. A word travels once for a chunk,
    however often it stands there, so no frequent word gathers in a task; a chunk holds CHUNK letters or
    one longer text, which bounds the memory. The plan is the same at every size. buckets: two to a
    shuffle partition unless given. block: bytes of text that are cut at a time.

    docs is read as a table: it must give the same rows in the same order if a lost task runs again;
    otherwise an error is raised, never a wrong result.

    Null and empty texts have no ids. Repeated rows and null ids each get their row. No special
    tokens. Extra columns are ignored. An empty table gives an empty one. ranks_path is read by the
    driver; tasks get the table by broadcast. A path that ends in .json is a file of the tokenizers library,
    whose pre-tokens must be those of PATTERN.
    """
    spark = docs.sparkSession
    kinds = spark.sparkContext.broadcast(classes())
    if ranks_path.endswith(".json"):
        with open(ranks_path, encoding="utf-8") as f:
            encoder = json_encoder(spark.sparkContext.broadcast(f.read()))
    else:
        encoder = rank_encoder(spark.sparkContext.broadcast(read_ranks(ranks_path)))
    buckets = buckets or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = chunk_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), kinds, buckets, block).repartition("key")

    def fill(texts: pa.Table, words: pa.Table) -> pa.Table:
        return _filled(texts, words, pa.schema([("id", texts.schema.field("ids").type.value_type), ("ids", pa.binary())]), Packer())

    kind = docs.schema[id_col].dataType.simpleString()
    # A filter that isn't deterministic stays behind the shuffle, and one that takes nulls implies no other, so both sides share it; a plain one would cut the texts twice.
    chunks = rows.filter(F.coalesce("kind", F.lit(-1)) + F.floor(F.rand()) != WORDS)
    filled = chunks.groupBy("key").cogroup(encode_words(rows, encoder).groupBy("key")).applyInArrow(fill, f"id {kind}, ids binary")
    return filled.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with the column decoded: the bytes of its ids, by the token-byte table, a broadcast of the vocabulary's size."""
    ranks = read_ranks(ranks_path)
    count = max(ranks.values(), default=-1) + 1
    tokens_of = [b""] * count
    for token, rank in ranks.items():
        tokens_of[rank] = token
    sizes = np.array([len(t) for t in tokens_of], np.int64)
    table = tokens.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens_of), np.uint8), sizes, np.cumsum(sizes) - sizes))

    def run(batches):
        flat, size, begin = table.value
        for batch in batches:
            for a, b, part in _runs(batch.column(ids_col)):
                ids = np.frombuffer(b"".join(x or b"" for x in part), "<u4")
                n = size[ids]
                ends = np.concatenate([[0], np.cumsum(n)])
                data = flat[np.repeat(begin[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
                bounds = ends[np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in part])])].tolist()
                out = [None if x is None else data[u:v] for x, u, v in zip(part, bounds, bounds[1:], strict=False)]
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], names=[*rows.schema.names, "decoded"])

    return tokens.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + ", decoded binary")


def _runs(column: pa.Array):
    """(first row, row after the last, values) of runs of values of about BLOCK ids; no more of them are held at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 4 * BLOCK, "right")))
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b
