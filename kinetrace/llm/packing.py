"""Best-fit packing of documents into sequences, in order of falling length.

A document is its token ids and an end id. Only longer ones than a sequence are cut, into full pieces and a last, shorter one.
Full pieces are sequences of their own. The others are placed in order of falling length, each into the open bin with the smallest
gap that it fits in; a bin is opened only for a piece that fits in none.

Where a piece may go depends on its length alone, so it is the histogram of lengths that is packed: at most ``capacity`` numbers
reach the driver, whatever the corpus. A piece that leaves a gap of its own length or more makes that gap the smallest that its
equals fit in, so they fill one bin after the other, and all bins of a gap at once: see :func:`best_fit`. Places are those of single
pieces at every size, in a number of steps that the capacity bounds. Pieces then look up their places by length and by their running
number among the pieces of that length, which each task counts on its own; the numbers of tasks before it are summed up per task and length.

:func:`plan` is another rule, for callers who give :func:`pack` a number of steps: a piece goes where the sum over gaps of the squared
number of open bins with that gap becomes smallest; of equal ones the smallest gap is taken. More pieces than steps are placed several
at a time: ``w`` equal ones into ``w`` equal bins, for a w that leaves about as many steps; what a length has left over is placed in
the same open bins by a sixteenth of w, and so on down to single pieces. So its places depend on how many pieces there are.

Null text counts as empty and becomes one piece of the end id alone. Repeated ids, null ids and repeated texts are pieces of their
own. Extra columns don't matter, whatever their names. An empty table gives an empty result. A text of any length is encoded whole, in
one worker's memory. Only pieces' lengths and checksums are shuffled, no text and no ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow, byte_slices, released
from .tokens import crc32, encoder, vocabulary

#: Steps of :func:`plan` among which pieces are placed, about; and the factor from one size of step to the next.
ITEMS, FINER = 1 << 16, 16


@dataclass(frozen=True)
class Plan:
    """Places of the pieces of each length, in order of ``key``: length and first running number, from which ``copies`` pieces go into
    bins in a row, ``each`` in a bin, from ``offset`` on."""

    key: np.ndarray
    copies: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    n_bins: int

    def look_up(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each piece, given its length and running number."""
        at = np.searchsorted(self.key, (length << 48) + number, side="right") - 1
        nth = number - (self.key[at] & ((1 << 48) - 1))
        return self.bin[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


class Bins:
    """Open bins by gap, as runs of equal bins in a row: [first, how many]."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # open bins by gap, in the step's size; full ones don't count
        self.runs: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def resize(self, factor: int) -> None:
        """From now on a step is a ``factor``-th of what it was."""
        self.count *= factor

    def place(self, s: int, w: int) -> tuple[int, int]:
        """Puts w pieces of length s into w bins in a row: the first bin, and the pieces' offset."""
        # From gap g to g - s the sum changes by 2 (n[g-s] - n[g]) + 2, or by 1 - 2 n[g] if the bin is full then.
        count, capacity = self.count, self.capacity
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] -= 1 + 2 * count[0]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        g = int(change.argmin()) + s
        if count[g]:
            run = self.runs[g][-1]
            run[1] -= w
            b = run[0] + run[1]
            if not run[1]:
                self.runs[g].pop()
            count[g] -= 1
        else:
            g, b = capacity, self.n
            self.n += w
        if g - s:
            self.runs[g - s].append([b, w])
            count[g - s] += 1
        return b, capacity - g


def plan(counts: np.ndarray, items: int = ITEMS) -> Plan:
    """Packs ``counts[s]`` pieces of each length s below the capacity, which is the last place of ``counts``."""
    left, used, bins = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), Bins(len(counts) - 1)
    left[-1] = 0
    w, steps = 1 << max(0, (int(left.sum()) // items).bit_length()), []
    while True:
        for s in np.flatnonzero(left >= w)[::-1].tolist():
            for _ in range(int(left[s]) // w):
                steps.append((s, int(used[s]), w, *bins.place(s, w)))
                used[s] += w
        left %= w
        if w == 1:
            break
        finer = max(1, w // FINER)
        bins.resize(w // finer)
        w = finer
    return _planned([(*step, 1) for step in steps], bins.n)


def _planned(steps: list[tuple[int, ...]], n_bins: int) -> Plan:
    """The plan of steps (length, first running number, copies, bin, offset, each)."""
    got = np.array(steps, np.int64).reshape(-1, 6)
    key = (got[:, 0] << 48) + got[:, 1]
    order = np.argsort(key, kind="stable")
    return Plan(key[order], *(got[order, k] for k in (2, 3, 4, 5)), n_bins)


def best_fit(counts: np.ndarray) -> Plan:
    """Packs ``counts[s]`` pieces of each length s below the capacity, which is the last place of ``counts``, as if one by one.

    A step fills a run of bins with one gap, so afterwards the gap is smaller than the length. A length adds three runs at most, and
    each filling of a run halves its gap at least; so there are some 3 * capacity * log2(capacity) steps at most, of however many pieces.
    """
    capacity, n = len(counts) - 1, 0
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: first bin, how many in a row
    held, steps = np.zeros(capacity + 1, bool), []

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            runs[gap].append((first, many))
            held[gap] = True

    for s in np.flatnonzero(counts[:capacity])[::-1].tolist():
        used, left = 0, int(counts[s])
        while left:
            g = int(held[s:].argmax()) + s
            if held[g]:
                first, many = runs[g].pop()
                held[g] = bool(runs[g])
            else:
                g, first, many = capacity, n, -(-left // (capacity // s))
                n += many
            each = g // s
            full, rest = min(many, left // each), 0
            if full < many and left > full * each:
                rest = left - full * each  # what the last bin gets
            placed = full * each + rest
            steps.append((s, used, placed, first, capacity - g, each))
            leave(g - each * s, first, full)
            if rest:
                leave(g - rest * s, first + full, 1)
            leave(g, first + full + bool(rest), many - full - bool(rest))
            used += placed
            left -= placed
    return _planned(steps, n)


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece."""
    path = path or vocabulary()
    schema = f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, enc = shape, encoder(path)
        for part, _, _ in byte_slices(batches):
            ids, bounds = enc.encode_ended([t or "" for t in part.column("text").to_pylist()], end_id)
            n = np.maximum(1, -(-np.diff(bounds) // capacity))
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            a = bounds[:-1][row] + start
            b = np.minimum(a + capacity, bounds[1:][row])
            crc = np.fromiter((crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
            yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(b - a), pa.array(crc)], schema=to)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), "text").mapInArrow(released(run), schema)


def numbered(items: DataFrame) -> DataFrame:
    """``items`` with ``task`` and ``nth``, the running number of each among the task's pieces of that length."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", task int, nth bigint"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to, task, seen = shape, TaskContext.get().partitionId(), np.zeros(1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            order = np.argsort(length, kind="stable")
            rising = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.searchsorted(rising, rising)
            seen = np.pad(seen, (0, max(0, int(rising[-1]) + 1 - len(seen))))
            nth += seen[length]
            seen += np.bincount(length, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task), pa.int32()), pa.array(nth)], schema=to)

    return items.mapInArrow(run, schema)


def pack(scratch: Scratch, items: DataFrame, capacity: int = 4096, steps: int | None = None) -> DataFrame:
    """``items`` (as of :func:`pieces`) with sequence_id and offset, by :func:`best_fit`; or by :func:`plan` in about so many steps."""
    columns = items.columns
    items = scratch.write(numbered(items), "pieces")
    sizes = scratch.write(items.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")), "sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # one row per length, capacity at most
        counts[length] = n
    shipped = scratch.spark.sparkContext.broadcast(best_fit(counts) if steps is None else plan(counts, steps))  # a row per step, see there
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    # Names of their own: ``items`` may hold any.
    shifts = sizes.select(F.col("task").alias("of_task"), F.col("length").alias("of_length"), before.alias("before"))
    placed = items.join(shifts, (F.col("task") == F.col("of_task")) & (F.col("length") == F.col("of_length"))).select(*columns, (F.col("nth") + F.col("before")).alias("number"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.drop("number").schema) + ", sequence_id bigint, offset bigint"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, places = shape, shipped.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at, offset, short = places.n_bins + number, np.zeros(len(length), np.int64), length < capacity
            at[short], offset[short] = places.look_up(length[short], number[short])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at), pa.array(offset)], schema=to)

    return placed.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch, pieces(docs, capacity, end_id, path), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, packed: DataFrame, end_id: int = 1, path: str | None = None) -> DataFrame:
    """The sequences themselves: (sequence_id, ids array<int>), from documents and their places. A sequence is bounded by its capacity.

    Documents find their pieces by doc_id, which must be unique here.
    """
    path = path or vocabulary()
    shape = arrow("doc_id bigint, all_ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, enc = shape, encoder(path)
        for part, _, _ in byte_slices(batches):
            ids, bounds = enc.encode_ended([t or "" for t in part.column("text").to_pylist()], end_id)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], schema=to)

    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, all_ids array<int>")
    cut = whole.join(packed, "doc_id").select("sequence_id", "offset", F.expr("slice(all_ids, cast(start as int) + 1, cast(length as int))").alias("ids"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
