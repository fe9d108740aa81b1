"""The trie of conversations: prefixes of turns, found by digests of fixed-length blocks of turns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.stored import stored

#: Turns to a block, and blocks to a block of blocks.
BLOCK = 4
#: Letters of ids to a row when the ids of a node are joined.
CHUNK = 1 << 16
ROOT = "root"


def _hash(*parts):
    """128 bits of SHA-256 as hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def number_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, first, before, at, turn_hash, chars): every turn with its digest; its place from 0 is before + at - first.

    Turns stand by turn number (null first), ties by role and text; null role and text are empty. Rows
    are sorted by range of conversation and turn, so a conversation with a third of all rows lies in
    many tasks; what stands before a task's rows of a conversation is summed over counts.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    keys = ["conv", "turn", "role", "text", "row"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    digest = _hash(F.char_length("role").cast("string"), F.concat("role", "text"))
    placed = stored(placed.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), digest.alias("turn_hash"), F.char_length("text").cast("long").alias("chars")), "turns")
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return placed.join(runs, ["conv", "part"])


def with_shared_heads(numbered: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations(conv), turns(conv, pos, turn_hash, chars)): each conversation's first h turns are those of conversation c - c % group.

    h is crc32(decimal c) % most; a head that is shorter gives all it has, an absent one nothing, and
    the conversation's own turns follow from its turn h on.
    """
    head = lambda c: F.crc32(c.cast("string")) % most
    rows = numbered.select("conv", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "turn_hash", "chars")
    heads = rows.filter((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base")
    convs = numbered.select("conv", "part").distinct().select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", head(F.col("conv")))
    convs = stored(convs.join(heads.groupBy("base").agg(F.count("*").alias("has")), "base", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0)))), "heads")
    taken = heads.join(convs.select("conv", "base", "h"), "base").filter("pos < h").select("conv", "pos", "turn_hash", "chars")
    own = rows.filter(F.col("pos") >= head(F.col("conv"))).join(convs.select("conv", "h", "k"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_hash", "chars")
    return convs.select("conv"), taken.unionByName(own)


def _blocks(below: DataFrame, level: int) -> DataFrame:
    """(conv, i, hash, full, kids): BLOCK entries of the level below (conv, i, hash, full, chars) to a block."""
    kid = F.struct("i", "hash", "full", "chars")
    made = below.groupBy("conv", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    full = (F.size("kids") == BLOCK) & F.forall("kids", lambda k: k["full"])
    return made.select("conv", F.col("block").alias("i"), _hash(F.lit(f"b{level}"), F.array_join(F.transform("kids", lambda k: k["hash"]), "|")).alias("hash"), full.alias("full"), "kids")


def _refine(edges: DataFrame, blocks: DataFrame, level: int) -> DataFrame:
    """The steps inside the blocks that edges stand for, ungrouped: one row for each edge and entry of its block."""
    opened = edges.join(blocks.select("conv", "i", "kids", "full"), ["conv", "i"])
    chain = F.aggregate("kids", F.array("parent"), lambda a, k: F.concat(a, F.array(_hash(F.element_at(a, -1), F.lit(f"p{level}"), k["hash"]))))
    # a full block ends where its edge ends, under the edge's name
    opened = opened.withColumn("chain", chain).withColumn("chain", F.when(F.col("full"), F.concat(F.slice("chain", 1, F.size("chain") - 1), F.array("id"))).otherwise(F.col("chain")))
    last = F.col("j") == F.size("kids") - 1
    step = opened.select("*", F.posexplode("kids").alias("j", "kid"))
    return step.select(
        F.element_at("chain", F.col("j") + 2).alias("id"), F.element_at("chain", F.col("j") + 1).alias("parent"), F.col("parent").alias("zone"), F.slice("chain", F.lit(2), F.col("j") + 1).alias("path"), F.col("kid.i").alias("i"), F.col("kid.full").alias("full"),
        F.col("kid.chars").alias("chars"), "n", "conv", F.when(last, F.col("ends")).alias("ends"), "lone",
    )


def _merged(steps: DataFrame) -> DataFrame:
    """Steps that are the same prefix as one; those of blocks without siblings are alone already."""
    same = [F.first(c).alias(c) for c in ("parent", "zone", "path", "i", "full", "chars")]
    met = steps.filter("NOT lone").groupBy("id").agg(*same, F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("ends").alias("ends"))
    return met.unionByName(steps.filter("lone").drop("lone"))


def _lone(edges: DataFrame) -> DataFrame:
    """edges with lone: whether no other edge has the same parent. Joined on the edge, so no parent is a hot key."""
    alone = edges.groupBy("parent").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other").select("id", F.lit(True).alias("alone"))
    return edges.join(alone, "id", "left").withColumn("lone", F.coalesce("alone", F.lit(False))).drop("alone")


def trie_levels(turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(steps by level, last(conv, ends)): the distinct prefixes that end at a turn, at a block, at a block of blocks and so on.

    turns(conv, pos, turn_hash, chars). The digest of a block is that of its BLOCK entries, and blocks of
    blocks go on until one holds the longest conversation, so work on a conversation of m turns takes
    log(m) levels. From the top down, conversations meet by the digests of their blocks in a row; each
    distinct block behind a prefix is opened once for all that share it, from its least conversation,
    and only where the prefix has several blocks behind it do the entries inside meet by their prefix.
    A prefix is named after the aligned blocks that make it up, so it has one name whoever has it.
    """
    longest = turns.agg(F.max("pos")).first()[0]
    if longest is None:
        return [], turns.select("conv", F.lit("").alias("ends"))
    at, level, span = turns.select("conv", F.col("pos").alias("i"), F.col("turn_hash").alias("hash"), F.lit(True).alias("full"), "chars"), 0, 1
    blocks = []
    while True:
        level, span = level + 1, span * BLOCK
        made = stored(_blocks(at, level), f"blocks{level}")
        blocks.append(made)
        if span > longest:
            break
        at = made.select("conv", "i", "hash", "full", F.lit(0).cast("long").alias("chars"))
    top = blocks[-1]
    edges = top.groupBy("hash").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).select("n", "conv", F.lit(ROOT).alias("parent"), _hash(F.lit(ROOT), F.lit(f"p{level}"), "hash").alias("id"), F.lit(0).cast("long").alias("i"), F.col("hash").alias("ends"), F.lit(False).alias("lone"))
    levels = []
    for below in range(level - 1, -1, -1):
        steps = stored(_merged(_refine(edges, blocks[below], below)), f"steps{below}")
        levels.insert(0, steps)
        edges = _lone(steps.select("n", "conv", "parent", "id", "i", "ends")) if below else None
    return levels, top.select("conv", F.col("hash").alias("ends"))


def _ends_hash(last: DataFrame) -> DataFrame:
    """(ends, ends_sha256): SHA-256 of the ascending, comma-joined conversations of each key; last(ends, conv).

    Runs of ids are joined where they lie after a sort by range, so that a key with a third of all
    conversations reaches the task that hashes it as a few long strings.
    """

    def joined(batches):
        key, first, ids, size = None, None, [], 0
        row = lambda: pa.RecordBatch.from_pydict({"ends": [key], "first": pa.array([first], pa.int64()), "ids": [",".join(ids)]})
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or size > CHUNK):
                    yield row()
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1])
        if ids:
            yield row()

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"ends": [r[0] for r in out], "ends_sha256": [r[1] for r in out]})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"ends": [key], "ends_sha256": [state.hexdigest()]})

    runs = last.select("ends", F.col("conv").cast("long")).repartitionByRange("ends", "conv").sortWithinPartitions("ends", "conv").mapInArrow(joined, "ends string, first long, ids string")
    return runs.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(hashed, "ends string, ends_sha256 string")


def _subtree_sums(levels: list[DataFrame], weights: DataFrame, names: list[str]) -> DataFrame:
    """(id, *names): the sums of weights(id, *names) over each prefix and all that it begins.

    A prefix passes its weight to those before it in its block only; what a whole block holds counts for
    the prefix in front of it, one level up, so the levels and not the turns are walked.
    """
    total = lambda df, key: df.groupBy(F.col(key).alias("id")).agg(*(F.sum(c).alias(c) for c in names))
    carried = [weights]
    for below, above in zip(levels, levels[1:], strict=False):
        zone = total(below.select("id", "zone").join(carried[-1], "id"), "zone")
        carried.append(stored(above.filter("full").select("id").join(zone, "id"), "zones"))
    sums = None
    for k in range(len(levels) - 1, -1, -1):
        steps = levels[k].filter("full").select("id", "path").join(carried[k], "id", "left").fillna(0, names)
        if sums is not None:
            more = sums.select("id", *(F.col(c).alias(f"_{c}") for c in names))
            steps = steps.join(more, "id", "left").select("path", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names))
        sums = stored(total(steps.select(F.explode("path").alias("to"), *names), "to"), "sums")
    return sums


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(node_id, parent_id, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a distinct prefix.

    convs(conv): all conversations, those without turns too; turns(conv, pos, turn_hash, chars) with
    places from 0 without gaps. The last turn of a node is turn depth - 1 of conversation conv_id, its
    smallest member. Equal conversations are one path. No conversations, no rows: not even a root.
    """
    levels, last = trie_levels(turns)
    ends = convs.select("conv").distinct().join(last, "conv", "left").select(F.coalesce("ends", F.lit("")).alias("ends"), "conv")
    hashes = _ends_hash(ends)
    root = convs.agg(F.count_distinct("conv").alias("n_convs"), F.min("conv").alias("conv_id")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit("").alias("ends"), F.lit(0).cast("long").alias("own"))
    if not levels:
        nodes = root.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
        nodes = nodes.withColumn("parent_conv_id", F.lit(None).cast("long"))
    else:
        steps = levels[0].select(F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), F.col("conv").alias("conv_id"), (F.col("i") + 1).alias("depth"), F.col("n").alias("n_convs"), "ends", ((F.col("n") - 1) * F.col("chars")).alias("own"))
        kids = steps.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
        nodes = stored(steps.unionByName(root).join(kids, "node_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
        weights = nodes.filter("depth > 0").select(F.col("node_id").alias("id"), F.col("own").alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
        sums = _subtree_sums(levels, weights, ["saved_tokens", "n_leaves"])
        every = weights.agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves")).select(F.lit(ROOT).alias("id"), "saved_tokens", "n_leaves")
        nodes = nodes.join(sums.unionByName(every).withColumnRenamed("id", "node_id"), "node_id")
        above = nodes.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
        nodes = nodes.join(above, "parent_id", "left")
    # a node that no conversation ends at looks for its own name, so that no missing key is a hot one
    nodes = nodes.withColumn("ends", F.coalesce("ends", "node_id")).join(hashes, "ends", "left")
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select("node_id", "parent_id", *long, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
