"""N-gram Jaccard join over count vectors in a distributed R-tree.

Shingles are hashed into groups, about as many as a text has shingles; a text's group counts are a
point, and the overlap of two texts is at most the sum of the coordinate minima of their points. One
tree over all points can't prune: hashed counts of unrelated texts lie close together in every coordinate but the size, so the
boxes of a global tree overlap and nearly every pair of leaves survives. The points are therefore
first dealt to forests of trees by shared signature shingles, which loses no link: of two linked
texts each has one of the other's first n - ceil(t n) + 1 shingles among its own, in any order that
is the same for all texts. The order here: shingles whose hash is in the lowest REGION of all hashes
and that one text alone holds, then those of the region that more hold, rare first, then the rest by
hash. A text that has enough shingles of its own in the region links with nothing and takes no part,
so passages that many texts share make no forests of unrelated texts. A large forest is cut in tiles by
size, tiles are paired by their sizes, and each pair of tiles is searched as a tree: box against box,
point against point. The true sets are read only for texts with a surviving pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bytetext import Words, blocks, mix, shingle_sets
from siltstone.llm.stored import connected_components, maybe_in, stored

LEAST_GROUPS, MOST_GROUPS = 128, 4096
#: The lowest hashes that are counted, in shares of a signature: enough for texts that share a quarter of their shingles.
REGION = 1.45
LEAF = 16
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 20


def _set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64)) if len(s) else 0


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sets(batch: pa.RecordBatch, k: int, text: int = 1):
    for a, b, data, offsets in blocks(batch.column(text)):
        yield a, shingle_sets(Words(data, offsets, lower=True), k)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, key) of every text: its set's size and a hash of the set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, sets in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.int64())], names=["id", "n", "key"])

    return docs.mapInArrow(run, f"id {kind}, n long, key long")


def signature_length(n: int, num: int, den: int) -> int:
    """So many shingles of a set of n, in any common order, that no linked set misses all of them."""
    return n - -(-num * n // den) + 1 if n else 0


def signatures(docs: DataFrame, k: int, num: int, den: int, region: float = REGION, bare: bool = False) -> DataFrame:
    """(sig, key, id, n, rc, inside): each set's rc shingles of the region, and more in hash order where these are too few; bare: (sig, key) alone."""
    kind = docs.schema["id"].dataType.simpleString()
    edge = np.uint64(min(2**64 - 1, int(region * (den - num) / den * 2**64)))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, sets in _sets(batch, k):
                rc = [int(np.searchsorted(s, edge)) for s in sets]
                take = [s[: max(c, signature_length(len(s), num, den))] for s, c in zip(sets, rc, strict=True)]
                row = np.repeat(np.arange(len(sets)), [len(x) for x in take])
                sig = np.concatenate(take)
                of = lambda values: pa.array(np.array(values, np.int64)[row])  # noqa: E731, B023
                first = [_long(sig), of([_set_key(s) for s in sets])]
                if bare:
                    yield pa.RecordBatch.from_arrays(first, names=["sig", "key"])
                else:
                    more = [ids.take(pa.array(row + a)), of([len(s) for s in sets]), of(rc), pa.array(sig < edge)]
                    yield pa.RecordBatch.from_arrays([*first, *more], names=["sig", "key", "id", "n", "rc", "inside"])

    return docs.mapInArrow(run, "sig long, key long" if bare else f"sig long, key long, id {kind}, n long, rc long, inside boolean")


def groups_of(n: int) -> int:
    """How many groups a set of n shingles is counted in: a power of two, so that a finer point folds to a coarser."""
    return min(max(1 << max(n - 1, 1).bit_length(), LEAST_GROUPS), MOST_GROUPS)


def count_points(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, point) of the given (id, text) rows: the point is the counts of groups_of(n) groups in 1, 2 or 4 bytes each."""

    def point(s: np.ndarray) -> bytes:
        g = groups_of(len(s))
        c = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
        return c.astype(np.uint8 if c.max(initial=0) < 1 << 8 else np.uint16 if c.max() < 1 << 16 else np.uint32).tobytes()

    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s) for s in sets], pa.binary())], names=["key", "n", "point"])

    return docs.mapInArrow(run, "key long, n long, point binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, shingles) of the given (id, text) rows."""

    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "n", "shingles"])

    return docs.mapInArrow(run, "key long, n long, shingles binary")


def _linked(num: int, den: int):
    @F.pandas_udf(T.BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(a, b, strict=True)], dtype=bool)

    return linked


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |x and y| >= num * |x or y|, for sorted distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or den * len(x) < num * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


class Points:
    """Points of one or more sizes: the row numbers and the matrix of each size, and the same folded to half the size."""

    def __init__(self, n: np.ndarray, points: list[bytes]):
        self.n, self.size = n, np.array([groups_of(int(x)) for x in n], np.int64)
        self.place, self.own, self.half = np.zeros(len(n), np.int64), {}, {}
        for g in np.unique(self.size):
            at = np.flatnonzero(self.size == g)
            self.place[at] = np.arange(len(at))
            self.own[g] = np.stack([np.frombuffer(points[i], {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(points[i]) // g]) for i in at])
            if self.own[g].dtype != np.uint8:
                self.own[g] = self.own[g].astype(np.uint32)
            self.half[g] = self.own[g][:, : g // 2].astype(np.uint16 if self.own[g].dtype == np.uint8 else np.uint32) + self.own[g][:, g // 2 :]

    def kinds(self):
        """(size, size, matrix, matrix) of the comparisons that sets of about one size can need."""
        for g in self.own:
            yield g, g, self.own[g], self.own[g]
            if g // 2 in self.own:
                yield g, g // 2, self.half[g], self.own[g // 2]


def may_link(room: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an overlap of at most `room` allows sets of n and m to be similar enough."""
    return (room * (num + den) >= num * (n + m)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def tree_pairs(p: Points, rows: np.ndarray, side: np.ndarray, num: int, den: int):
    """(rows, rows) of the pairs whose summed coordinate minima allow a link, a pair of leaves at a time.

    A tree is packed for each size of points, by side, set size and first coordinates, in leaves of
    LEAF points with their box. A pair of leaves whose boxes can't reach the overlap that their
    smallest members need is passed over. side: 0 for one tile, where all meet; 1 and 2 for two tiles,
    where only different sides meet.
    """
    n, size = p.n, p.size
    for g, h, a, b in p.kinds():
        left, right = _leaves(p, rows[size[rows] == g], side, a), _leaves(p, rows[size[rows] == h], side, b)
        if not left or not right:
            continue
        high, least, sides = np.stack([x[1] for x in right]), np.array([n[x[0]].min() for x in right]), np.array([side[x[0][0]] for x in right])
        for i, (u, top) in enumerate(left):
            start = i if g == h else 0
            room = np.minimum(top, high[start:]).sum(1, dtype=np.int64)
            meet = (sides[start:] == 0) | (sides[start:] != side[u[0]])
            for j in start + np.flatnonzero(meet & (room * (num + den) >= num * (n[u].min() + least[start:]))):
                v = right[j][0]
                room2 = np.minimum(a[p.place[u]][:, None], b[p.place[v]][None]).sum(2, dtype=np.int64)
                ok = may_link(room2, n[u][:, None], n[v][None], num, den)
                if g == h and i == j:
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                if len(x):
                    yield u[x], v[y]


def _leaves(p: Points, rows: np.ndarray, side: np.ndarray, matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    if not len(rows):
        return []
    first = matrix[p.place[rows]]
    order = rows[np.lexsort((first[:, 1], first[:, 0], p.n[rows], side[rows]))]
    parts = [x for part in (order[side[order] == v] for v in np.unique(side[order])) for x in (part[i : i + LEAF] for i in range(0, len(part), LEAF))]
    return [(x, matrix[p.place[x]].max(0)) for x in parts]


def surviving(p: Points, group: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """A mark for each row with a surviving pair in its group; rows of a group stand together."""
    n, alive = p.n, np.zeros(len(p.n), bool)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= LEAF, sizes)
    for d in range(1, min(LEAF, len(group))):
        i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]) & ((side[:-d] == 0) | (side[:-d] != side[d:])))
        if not len(i):
            continue  # sides 1, 2, 1, 2 meet at 1 and 3, not at 2
        i = i[den * np.minimum(n[i], n[i + d]) >= num * np.maximum(n[i], n[i + d])]
        for g, h, a, b in p.kinds():
            for u, v in [(i, i + d)] if g == h else [(i, i + d), (i + d, i)]:
                at = np.flatnonzero((p.size[u] == g) & (p.size[v] == h))
                for part in np.array_split(at, len(at) * g // (1 << 24) + 1):
                    x, y = u[part], v[part]
                    ok = may_link(np.minimum(a[p.place[x]], b[p.place[y]]).sum(1, dtype=np.int64), n[x], n[y], num, den)
                    alive[x[ok]] = alive[y[ok]] = True
    for s, m in zip(starts[sizes > LEAF], sizes[sizes > LEAF], strict=True):
        for u, v in tree_pairs(p, np.arange(s, s + m), side, num, den):
            alive[u] = alive[v] = True
    return alive


def tile_links(pdf: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Links of a pair of tiles that join different components, enough of them to connect all that link.

    A surviving pair that is connected already is passed over, as it can't change the classes.
    """
    side, key, comp = (pdf[c].to_numpy() for c in ("side", "key", "comp"))
    points = Points(pdf["n"].to_numpy(), list(pdf["point"]))
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for us, vs in tree_pairs(points, np.arange(len(key)), side, num, den):
        for u, v in zip(us, vs, strict=True):
            cu, cv = find(int(comp[u])), find(int(comp[v]))
            if cu != cv and similar(sets[u], sets[v], num, den):
                root[max(cu, cv)] = min(cu, cv)
                found.append((int(key[u]), int(key[v])))
    return found


def _tile_rows(trees: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, t1, t2, side, key, n): the members of every pair of tiles of about one size; a tile pairs with itself too.

    trees(sig, key, n, c, s): c rows and s shingles in the row's tree. A tree over the bounds of a tile is cut
    by size classes of an eighth of an octave, and a class over them by a hash of the key, so that no tree is
    put in order in one task.
    """
    over = (F.col("c") > TILE_ROWS) | (F.col("s") > TILE_SHINGLES)
    trees = trees.withColumn("class", F.when(over, F.floor(F.log2(F.col("n").cast("double")) * 8).cast("long") + 1).otherwise(0))
    cells = trees.filter("class > 0").groupBy("sig", "class").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_SHINGLES)).alias("parts"))
    cells = stored(cells, "cells")
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0))
    trees = trees.join(cells, ["sig", "class"], "left").select("sig", "key", "n", (F.shiftleft("class", 32) + part).alias("tile"))
    tiles = stored(trees.filter("tile > 0").groupBy("sig", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most")), "tiles")
    x, y = tiles.alias("x"), tiles.alias("y")
    near = (den * F.col("x.most") >= num * F.col("y.least")) & (den * F.col("y.most") >= num * F.col("x.least"))
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.tile") < F.col("y.tile")) & near).select("x.sig", F.col("x.tile").alias("t1"), F.col("y.tile").alias("t2"))
    ends = F.array(F.struct(F.col("t1").alias("tile"), F.lit(1).alias("side")), F.struct(F.col("t2").alias("tile"), F.lit(2).alias("side")))
    sides = pairs.select("sig", "t1", "t2", F.explode(ends).alias("s")).select("sig", "t1", "t2", "s.tile", "s.side")
    own = trees.select("sig", F.col("tile").alias("t1"), F.col("tile").alias("t2"), F.lit(0).alias("side"), "key", "n")
    return own.unionByName(trees.filter("tile > 0").join(sides, ["sig", "tile"]).select(own.columns))


def _surviving_rows(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The tile rows with a pair that the points leave possible; rows(..., point)."""

    def mark(table: pa.Table) -> pa.Table:
        n, g, side = (table.column(c).to_numpy() for c in ("n", "g", "side"))
        points = Points(n, table.column("point").to_pylist())
        return table.filter(pa.array(surviving(points, g, side, num, den))).drop_columns(["point"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            g = table.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            rest = table.slice(last)
            if last:
                yield from mark(table.slice(0, last).combine_chunks()).to_batches()
        if rest is not None and len(rest):
            yield from mark(rest.combine_chunks()).to_batches()

    rows = rows.withColumn("g", F.xxhash64("sig", "t1", "t2")).repartition("g").sortWithinPartitions("g").select("g", "sig", "t1", "t2", "side", "key", "n", "point")
    return rows.mapInArrow(run, "g long, sig long, t1 long, t2 long, side int, key long, n long").drop("g")


def _different_groups(rows: DataFrame) -> DataFrame:
    """The tile rows of one of the pairs of tiles that hold the same members."""
    pair = ["sig", "t1", "t2"]
    members = rows.groupBy(*pair).agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key", "side")).alias("x"), F.bit_xor(F.xxhash64("key", "side", F.lit(1))).alias("y"))
    one = members.groupBy("c", "x", "y").agg(F.min(F.struct(*pair)).alias("p")).select("p.*")
    return rows.join(one, pair)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of every row: its class under links of Jaccard similarity num / den or more.

    A text's set: the distinct runs of k words of the A-Z lower-cased text; with fewer words the whole
    sequence as one. component_id is the least id reachable by links, the own one included. Texts
    without words, and null texts, have n_shingles 0 and link with nothing; rows with a null id do
    too, as they can't be named. Equal sets are one node, however many rows hold them. Rows that share
    an id each get their row. Extra columns are ignored. An empty table gives an empty one.
    """
    if 2 * num < den:
        raise ValueError("the similarity must be one half or more")  # points of linked sets are then one size apart at most
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = docs.filter("id IS NOT NULL")
    profile = stored(profiles(docs, k), "profiles")
    once = profile.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"))

    # the shingles that several sets share: counted before they meet, so that a common one is one row a task
    counted = signatures(named, k, num, den, bare=True).groupBy("sig").agg(F.count("*").alias("df"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    common = stored(counted.filter("lo < hi").select("sig", "df"), "common")
    sigs = maybe_in(signatures(named, k, num, den), ["sig"], common, 24).join(common, "sig")
    # and of each set the first ones as far as its signature reaches
    own = Window.partitionBy("id", "key", "inside")
    sigs = sigs.withColumn("c", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("df", "sig")))
    sigs = sigs.filter(f"NOT inside OR place <= n - cast(ceil({num} * n / {den}) as long) + 1 - (rc - c)")
    forests = stored(sigs.groupBy("sig", "key").agg(F.min("id").alias("id"), F.max("n").alias("n")), "forests")
    # forests of the same sets are one
    members = forests.groupBy("sig").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    one = stored(members.filter("c > 1").groupBy("c", "s", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "c", "s"), "one")
    forests = stored(forests.join(one, "sig"), "trees")

    # the points of their sets, and the tile rows that these leave
    active = forests.groupBy("key").agg(F.min("id").alias("id"))
    points = stored(count_points(maybe_in(named, ["id"], active.select("id")), k).join(active.select("key"), "key", "left_semi").dropDuplicates(["key"]), "points")
    rows = _tile_rows(forests.select("sig", "key", "n", "c", "s"), num, den).join(points.select("key", "point"), "key")
    # what survives of forests is often the same few sets, which need one search
    alive = stored(_different_groups(stored(_surviving_rows(rows, num, den), "surviving")), "alive")
    found = active.join(alive.select("key").distinct(), "key")
    sets = stored(full_sets(maybe_in(named, ["id"], found.select("id")), k).join(found.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")

    # each forest's first set against the others: connects most copies before any search
    firsts = stored(alive.select("sig", "key").join(active, "key").groupBy("sig").agg(F.min_by("key", F.struct("id", "key")).alias("first")), "firsts")
    a, b = sets.select(F.col("key").alias("first"), F.col("n").alias("an"), F.col("shingles").alias("as")), sets.select("key", F.col("n").alias("bn"), F.col("shingles").alias("bs"))
    spokes = alive.select("sig", "key").join(firsts, "sig").filter("first <> key").select("first", "key").distinct()
    spokes = spokes.join(a, "first").join(b, "key").filter(f"{den} * least(an, bn) >= {num} * greatest(an, bn)")
    spokes = stored(spokes.filter(_linked(num, den)("as", "bs")).select(F.col("first").alias("src"), F.col("key").alias("dst")), "spokes")
    comp = connected_components(spokes)

    # the pairs of tiles that aren't connected yet, with their sets
    left = alive.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    pair = Window.partitionBy("sig", "t1", "t2")
    left = left.withColumn("lo", F.min("comp").over(pair)).withColumn("hi", F.max("comp").over(pair)).filter("lo < hi").drop("lo", "hi")
    left = stored(left, "left")
    left = left.join(points.select("key", "point"), "key").join(sets.select("key", "shingles"), "key")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(tile_links(pdf, num, den), columns=["src", "dst"], dtype="int64")

    more = stored(left.groupBy("sig", "t1", "t2").applyInPandas(search, "src long, dst long").distinct(), "found")
    comp = connected_components(spokes.unionByName(more))

    # from sets back to rows
    least = once.withColumnRenamed("id", "least").join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = least.join(names, "component").select("key", "component_id")
    p = profile.withColumn("key", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("key")))
    return p.join(classes, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
