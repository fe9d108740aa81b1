"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.stored import connected_components, stored

TILE, RECALL = 1024, 0.996


def plan_tables(n: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors: so many bits that unrelated vectors leave about eight to a bucket, and so many tables that a pair at cosine `least` meets with probability `recall`."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / 8)), 8, 48))
    meet = (1 - np.arccos(min(max(least, 0.0), 1 - 1e-9)) / np.pi) ** bits
    return bits, max(4, int(np.ceil(np.log(1 - recall) / np.log1p(-meet))))


def sign_hashes(vectors: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """One integer of `bits` signs for each table and row; the planes follow from seed and dimension."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(2)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _close(x: np.ndarray, least: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[i], x[j]) >= least


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs (i, j) connect it with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def bucket_links(x: np.ndarray, group: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group with cosine >= least. side: 0 for a tile on its own, else 1 and 2 for the two tiles of a pair, of which only rows of different sides meet. Rows of a group stand together."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(sizes <= 24, sizes)
    for d in range(1, 24):
        i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]) & ((side[:-d] == 0) | (side[:-d] != side[d:]))) if d < len(group) else np.zeros(0, np.int64)
        if not len(i):
            continue
        for part in np.array_split(i, len(i) // 50_000 + 1):
            ok = part[_close(x, least, part, part + d)]
            left.append(ok), right.append(ok + d)
    for s, n in zip(starts[sizes > 24], sizes[sizes > 24], strict=True):
        a, b = np.nonzero(np.triu(x[s : s + n] @ x[s : s + n].T >= least, 1))
        ok = (side[s + a] == 0) | (side[s + a] != side[s + b])
        left.append(a[ok] + s), right.append(b[ok] + s)
    return np.concatenate(left), np.concatenate(right)


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors of equal, non-null label and equal length are compared by cosine in double precision. Sign
    hashes of `bits` random planes in `tables` tables choose the pairs: two vectors at an angle a meet in a
    table with probability (1 - a / pi) ** bits. Unless given, both follow from the number of different
    vectors (plan_tables), so that buckets stay small in any table and 99.6 % of the pairs at the bound
    are found, and nearly all above; every pair found is computed exactly, so none below `least` links.
    Equal vectors are one node and always link. n_links: other rows linked directly. component_id: the
    least id reachable by links, the own included. kept: whether the row's id is that one.

    Buckets of more than TILE nodes are searched as pairs of tiles, dealt by a hash of the node; a pair
    that meets in several tables counts in the first. A pair of tiles puts out two rows a node at most:
    how many it links with, and one node that it is connected with; no pairs. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with null id or label, link with
    nothing. Rows that share an id each get their row. Extra columns are ignored. An empty table gives
    an empty one.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "v")))
    nodes = stored(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v")), "nodes")

    if bits is None or tables is None:
        planned = plan_tables(nodes.count(), least)
        bits, tables = bits or planned[0], tables or planned[1]

    def hashed(batches):
        for batch in batches:
            v = batch.column(1)
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                part = v.take(pa.array(at))
                h = sign_hashes(_unit(np.asarray(part.flatten(), np.float64).reshape(len(at), n)), bits, tables)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), n), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, tables, dtype=np.int32)), pa.array(h.ravel()))], names=["node", "dim", "signs"])

    signs = stored(nodes.select("node", "v").mapInArrow(hashed, "node long, dim int, signs array<bigint>"), "signs")
    points = nodes.join(signs, "node").select("node", "label", "dim", "m", "v", "signs")

    bucket = ["label", "dim", "tab", "sign"]
    places = signs.join(nodes.select("node", "label"), "node").select("node", "label", "dim", F.posexplode("signs").alias("tab", "sign"))
    # buckets are counted before they meet; those of one node search nothing
    sizes = stored(places.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    places = places.join(sizes, bucket).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    places = places.withColumn("tile", F.pmod(F.xxhash64("node", "tab"), F.col("tiles")).cast("int"))
    # a tile meets itself and every later tile
    partner = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    places = places.withColumn("other", partner).select(*bucket, "node", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).alias("side"))
    group = [*bucket, "t1", "t2"]
    rows_in = places.join(points.select("node", "m", "v", "signs"), "node").withColumn("g", F.xxhash64(*group)).repartition("g").sortWithinPartitions("g", *group)

    def search(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            g = table.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            rest = table.slice(last)
            if last:
                yield from links(table.slice(0, last).combine_chunks())
        if rest is not None and len(rest):
            yield from links(rest.combine_chunks())

    def links(table):
        g, tab, node, dims, m, side = (table.column(c).to_numpy() for c in ("g", "tab", "node", "dim", "m", "side"))
        for n in np.unique(dims):
            at = np.flatnonzero(dims == n)
            part = table.take(pa.array(at)).combine_chunks()
            x = np.asarray(part.column("v").combine_chunks().flatten(), np.float64).reshape(len(at), n)
            i, j = bucket_links(_unit(x), g[at], side[at], least)
            s = np.asarray(part.column("signs").combine_chunks().flatten()).reshape(len(at), tables)
            new = np.concatenate([np.zeros(0, bool), *((s[a] == s[b]).argmax(1) == tab[at][a] for a, b in zip(np.array_split(i, len(i) // 100_000 + 1), np.array_split(j, len(i) // 100_000 + 1), strict=True))])
            i, j = i[new], j[new]
            near = np.bincount(i, m[at][j], minlength=len(at)) + np.bincount(j, m[at][i], minlength=len(at))
            got = np.flatnonzero(near)
            root = spanning(len(at), i, j)[got]
            yield pa.RecordBatch.from_arrays([pa.array(node[at][got]), pa.array(node[at][root]), pa.array(near[got].astype(np.int64))], names=["src", "dst", "near"])

    found = stored(rows_in.select("g", "tab", "dim", "side", "node", "m", "v", "signs").mapInArrow(search, "src long, dst long, near long"), "links")
    comp = connected_components(found.select("src", "dst")).withColumnRenamed("component", "c")
    linked = found.groupBy(F.col("src").alias("node")).agg(F.sum("near").alias("near"))
    named = nodes.select("node", "first", "m").join(comp, "node", "left").withColumn("c", F.coalesce("c", "node"))
    least_id = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "c").join(linked, "node", "left").select("node", "component_id", (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("n"))
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
