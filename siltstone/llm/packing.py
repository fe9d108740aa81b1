"""Packing token sequences: linear grouping, few-size configurations, best fit, by the counts of lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.stored import stored


def rounded_groups(counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: lengths in descending order cut into groups of equal cardinality; each is [(length, count)].

    counts[l]: sequences of length l. A group's size is its first, longest length. Neighbours of one size are one group.
    """
    total, made, at = int(counts.sum()), [], 0
    bounds = [total * (g + 1) // groups for g in range(groups)]
    now: list[tuple[int, int]] = []
    g = 0
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            take = min(left, bounds[g] - at)
            if take:
                now.append((length, take))
                at, left = at + take, left - take
            while g < groups and at == bounds[g]:
                if now and made and made[-1][0][0] == now[0][0]:
                    made[-1] += now
                elif now:
                    made.append(now)
                now, g = [], g + 1
                if g == groups:
                    break
    return made


def configurations(sizes: list[int], wanted: list[int], capacity: int, rounds: int = 4000) -> list[tuple[list[int], float]]:
    """A basic optimal solution of the configuration program: [(sequences of each size in a bin, bins)], as many as sizes.

    Column generation: duals of the present configurations price a knapsack over the sizes, whose best
    bin joins them until none is worth more than a bin. rounds only bounds the search for better ones.
    """
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(wanted, float)
    for _ in range(rounds):
        column, worth = _knapsack(sizes, np.linalg.solve(basis.T, np.ones(m)), capacity)
        if worth <= 1 + 1e-7:
            break
        bins, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        limit = np.where(step > 1e-9, np.maximum(bins, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(limit))] = column
    bins = np.maximum(np.linalg.solve(basis, need), 0)
    return [(np.rint(basis[:, j]).astype(int).tolist(), float(bins[j])) for j in range(m)]


def _knapsack(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(how often each size, its value): the most valuable bin, sizes may repeat. Copies of a size double from step to step."""
    best, tables = np.zeros(capacity + 1), []
    for i, size in enumerate(sizes):
        times = 1
        while times * size <= capacity:
            moved = best[: capacity + 1 - times * size] + times * value[i]
            better = np.flatnonzero(moved > best[times * size :] + 1e-12)
            if len(better):
                best = best.copy()
                best[better + times * size] = moved[better]
                tables.append((i, times, set((better + times * size).tolist())))
            times *= 2
    column, at = np.zeros(len(sizes)), int(np.argmax(best))
    worth = float(best[at])
    for i, times, taken in reversed(tables):
        if at in taken:
            column[i] += times
            at -= times * sizes[i]
    return column, worth


class Plan:
    """Bins in runs of equal layout, and what is placed in them: rows (length, first rank, bin, a bin's copies, offset).

    The sequences of one length are interchangeable, so a plan holds ranks among them and not sequences:
    its size follows from the number of lengths, at most the capacity, and of configurations.
    """

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.used: list[int] = [0] * (capacity + 1)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def new(self, count: int) -> int:
        first = self.bins
        self.bins += count
        return first

    def put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        """The next count sequences of a length, each to a bin, from bin first on."""
        self.rows.append((length, self.used[length], first, each, offset))
        self.used[length] += count

    def leave(self, first: int, count: int, room: int) -> None:
        if room and count:
            self.open.setdefault(room, []).append((first, count))

    def configure(self, groups: list[list[tuple[int, int]]], sizes: list[int], found: list[tuple[list[int], float]]) -> list[tuple[int, int]]:
        """Whole bins of each configuration, filled with the groups' actual sequences, the longest first; what is left of the groups."""
        left = [list(g) for g in groups]
        for config, bins in found:
            count = int(bins + 1e-6)
            runs = [(self.new(count), count, 0)] if count else []
            for g, times in enumerate(config):
                for _ in range(times):
                    after = []
                    for first, n, offset in runs:
                        while n:
                            if not left[g]:
                                after.append((first, n, offset))
                                break
                            length, have = left[g][0]
                            take = min(n, have)
                            self.put(length, take, first, 1, offset)
                            after.append((first, take, offset + length))
                            first, n = first + take, n - take
                            left[g][0] = (length, have - take)
                            if have == take:
                                left[g].pop(0)
                    runs = after
            for first, n, offset in runs:
                self.leave(first, n, self.capacity - offset)
        return [x for g in left for x in g]

    def best_fit(self, length: int, count: int) -> None:
        """count sequences of a length, each to the fullest bin that has room; new bins where none has."""
        rooms = sorted(r for r in self.open if r >= length)
        while count:
            if not rooms:
                each = self.capacity // length
                bins = -(-count // each)
                first = self.new(bins)
                self._fill(length, count, first, bins, self.capacity, each)
                return
            room = rooms.pop(0)
            each = room // length
            runs = self.open.pop(room)
            while runs and count:
                first, bins = runs.pop()
                taken = min(bins, -(-count // each))
                placed = min(count, taken * each)
                self._fill(length, placed, first, taken, room, each)
                count -= placed
                if taken < bins:
                    runs.append((first + taken, bins - taken))
            if runs:
                self.open.setdefault(room, []).extend(runs)

    def _fill(self, length: int, count: int, first: int, bins: int, room: int, each: int) -> None:
        """Fills bins of one room in order; only the last may get fewer than each."""
        self.put(length, count, first, each, self.capacity - room)
        full = count // each
        self.leave(first, full, room - each * length)
        if full < bins:
            self.leave(first + full, 1, room - (count - full * each) * length)


def pack_counts(counts: np.ndarray, capacity: int, groups: int, small: int) -> Plan:
    """The plan for counts[l] sequences of each length l from 1 to capacity.

    Full sequences fill a bin. Lengths over small are rounded up within groups of equal cardinality, the
    program over the few sizes is solved, and the whole bins of its configurations take the groups' actual
    sequences. Those left over, at most one bin a size, and then the small ones go to the fullest bin
    that has room, longest first.
    """
    plan = Plan(capacity)
    counts = counts.copy()
    if counts[capacity]:
        plan.put(capacity, int(counts[capacity]), plan.new(int(counts[capacity])), 1, 0)
        counts[capacity] = 0
    large = counts.copy()
    large[: small + 1] = 0
    rest = {int(n): int(counts[n]) for n in np.flatnonzero(counts[: small + 1])}
    if large.sum():
        made = rounded_groups(large, min(groups, int(large.sum())))
        sizes = [g[0][0] for g in made]
        for length, n in plan.configure(made, sizes, configurations(sizes, [sum(n for _, n in g) for g in made], capacity)):
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        plan.best_fit(length, rest[length])
    return plan


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one where they fit, else full ones behind a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(tokens: DataFrame, capacity: int, end_id: int, id_col: str, ids_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank): the pieces of each row; rank counts the pieces of a length within a task."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, ids in enumerate(batch.column(1)):
                data = memoryview((ids.as_py() or b"") + end)
                for piece, (start, n) in enumerate(cut_pieces(len(data) // 4, capacity)):
                    at.append(i)
                    rows.append((piece, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), int(seen[n])))
                    seen[n] += 1
            piece, start, n, crc, rank = (np.array([r[j] for r in rows], np.int64) for j in range(5))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece.astype(np.int32)), *map(pa.array, (start, n, crc, np.full(len(rows), part, np.int64), rank))], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long")


def pack(tokens: DataFrame, capacity: int = 2048, end_id: int = 0, groups: int = 128, small: int = 256, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): all pieces of tokens(id, ids), in few sequences of at most capacity.

    ids are little-endian unsigned 32-bit integers, behind which end_id is put. A row of more than capacity
    is cut. Only the counts of lengths, at most capacity of them, reach the driver; the plan that it makes of
    them, rows of (length, first rank, bin, copies, offset), is bounded by lengths and configurations and
    is broadcast. A piece's rank among all pieces of its length is its rank in its task plus
    the counts of the tasks before, so the pieces of one length are never gathered.

    Null ids are empty. Repeated rows and null row ids are packed each. Extra columns are ignored. An
    empty table gives an empty one.
    """
    rows = stored(pieces(tokens, capacity, end_id, id_col, ids_col), "pieces")
    cells = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    plan = np.array(sorted(pack_counts(counts, capacity, groups, small).rows), np.int64).reshape(-1, 5)
    held = tokens.sparkSession.sparkContext.broadcast(plan)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(cells, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        plan = held.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
