"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles, as 64-bit hashes, and ``K`` minwise values of that set. Documents with equal
sets form a class and take part once; a class is named by 64 bits and checked by 64 more, and renamed if two sets share a name. Each of
``TREES`` independent trees branches classes by chosen minwise values: a node is a path of coordinates and values, and its members
agree on all of them. Nodes of at most ``LEAF`` members are compared exhaustively by their minwise values.

Of a larger node about ``PROBE`` members, picked by a hash, say what to do with it. If many of them are alike, one of those, the
hub, is compared with all members, and what is similar to it is labelled by it: a label says of which family a class is known to be.
Members with the node's most frequent label needn't meet one another. So a node with one label is done, and where at most ``FEW`` times
LEAF members lack the most frequent one, these meet all others in blocks, which is linear in the node. Else all but the hub branch on, by
coordinates taken at random: by two, and by a third if the chances that two members agree on them sum up to ``WORK`` at most. What is large
still after ``LEVELS`` levels meets in blocks against blocks.

Of minwise values 32 bits decide about nodes at the root; below it and in comparisons 8 bits do, which costs a few more
comparisons. Pairs whose minwise values agree often enough (five standard deviations below the threshold still pass) are candidates, of which
a spanning forest per node is kept; their components are families. No link leaves a family. A family of at most ``LEAF`` members
is one task's work, which holds candidates' full sets against each other and names its components. In larger families blocks of
members are held against blocks, on sets of 32-bit hashes; of what passes each pair of blocks gives a spanning forest, which is
confirmed on full sets. So near misses and links, of which a large family has very many, aren't listed. In families
beyond ``BLOCKS`` blocks candidates are confirmed first, and only members that this leaves apart are held against others.

Nulls and texts without words have an empty set and link with nothing. Rows with a null doc_id link with nothing either; their
component is null and they are kept. Repeated rows are of one class. Extra columns don't matter, whatever their names. An empty table
gives an empty result. A text of any length is read whole; words are hashed in windows of ``WINDOW`` bytes, so beyond a text's own
bytes a worker holds about 40 bytes for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, byte_slices, components, parts

K, TREES, LEAF, LEVELS, BLOCK = 64, 10, 512, 16, 256
#: Members of a large node by which it is judged; coordinates by which it branches, at least and at most; what their chances sum up to.
PROBE, LEAST_WAYS, WAYS, WORK = 256, 2, 3, 1.0
#: Blocks of members without a node's most frequent label that meet all others at once.
FEW = 4
#: Blocks of a family that is compared without confirming its candidates first.
BLOCKS = 16
ODD = 0x9E3779B97F4A7C15
WINDOW, NEAR = 1 << 20, 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random number for each byte at each place of a word."""
    return mix((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(ODD))


@cache
def letter_table() -> np.ndarray:
    """:func:`letters` of the first NEAR places, by place and byte, with A-Z as a-z."""
    return letters(np.arange(NEAR, dtype=np.uint64)[:, None], LOWER[None]).ravel()


SEEDS = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(ODD))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's start and hash, A-Z as a-z. A word's hash sums up random numbers for its bytes and their places."""
    size, table, a, starts, hashes = len(data), letter_table(), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while a < size:
        b = min(size, a + WINDOW)
        while b < size and not len(blank := np.flatnonzero(SPACE[data[b : b + WINDOW]])):
            b = min(size, b + WINDOW)
        b += int(blank[0]) if b < size else 0
        part = data[a:b]
        inside = ~SPACE[part]
        first = np.zeros(len(part), bool)
        cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[cuts] = True
        first[1:] |= ~inside[:-1]
        first[:1] = True
        at = np.flatnonzero(inside)
        begin = np.flatnonzero(first[at])  # among the bytes of words
        length = np.diff(np.append(begin, len(at)))
        place = np.arange(len(at)) - np.repeat(begin, length)
        byte = part[at]
        value = table[np.minimum(place, NEAR - 1) * 256 + byte]
        if len(far := np.flatnonzero(place >= NEAR)):
            value[far] = letters(place[far], LOWER[byte[far]])
        if len(begin):
            starts.append(at[begin] + a)
            hashes.append(mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        a = b
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in rising order, one text after the other, and n + 1 bounds."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    starts, word = words(data, offsets)
    of = np.searchsorted(starts, offsets)  # each text's first word
    count = np.diff(of)
    out, got = [], np.zeros(n, np.int64)
    factor = mix(np.arange(101, 101 + width, dtype=np.uint64))
    whole = sum(word[k : max(k, len(word) - width + 1 + k)] * factor[k] for k in range(width)) if len(word) >= width else np.zeros(0, np.uint64)
    whole = mix(whole + np.uint64(width))
    for i in np.flatnonzero(count).tolist():
        a, b = int(of[i]), int(of[i + 1])
        if b - a >= width:
            h = whole[a : b - width + 1].copy()
            h.sort()
            keep = np.ones(len(h), bool)
            keep[1:] = h[1:] != h[:-1]
            h = h[keep]
        else:
            h = mix((word[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        out.append(h)
        got[i] = len(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(got)])


def minwise(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """K 32-bit values for each set that isn't empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), K), np.uint32)
    if len(starts):
        for k in range(K):
            x = (sets ^ SEEDS[k]) * np.uint64(ODD)
            x ^= x >> np.uint64(32)
            low = np.minimum.reduceat(x * np.uint64(0xD6E8FEB86659FD93), starts)
            out[:, k] = (low ^ (low >> np.uint64(29))).astype(np.uint32)
    return out


def set_keys(sets: np.ndarray, bounds: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit name for each set that isn't empty."""
    full = np.diff(bounds) > 0
    starts = bounds[:-1][full]
    if not len(starts):
        return np.zeros(0, np.int64)
    return mix(np.add.reduceat(mix(sets ^ np.uint64(salt)), starts) + np.diff(bounds)[full].astype(np.uint64)).view(np.int64)


TWIN = 0x14057B7EF767814F


def signatures(docs: DataFrame, width: int, trees: int = TREES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cls, twin, sig, root): cls and twin name the set; sig holds 8 bits of each minwise value, root all
    of those that the trees' roots ask for. All four are null for an empty set."""
    schema = "doc_id bigint, text_hash bigint, n_shingles bigint, cls bigint, twin bigint, sig binary, root binary"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in byte_slices(batches, most=1 << 20):
            sets, bounds = shingle_sets(data, offsets, width)
            full = np.diff(bounds) > 0
            key, twin, sig, root = np.zeros(len(full), np.int64), np.zeros(len(full), np.int64), [None] * len(full), [None] * len(full)
            key[full], twin[full] = set_keys(sets, bounds), set_keys(sets, bounds, TWIN)
            for i, row in zip(np.flatnonzero(full).tolist(), minwise(sets, bounds), strict=True):
                sig[i], root[i] = row.astype(np.uint8).tobytes(), row[np.arange(trees) % K].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(bounds)), pa.array(key, mask=~full), pa.array(twin, mask=~full), pa.array(sig, pa.binary()), pa.array(root, pa.binary())], schema=shape)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _path(path: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(path + np.uint64(0xABCDEF)) ^ mix(value.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)))).view(np.int64)


def roots(classes: DataFrame, trees: int) -> DataFrame:
    """(tree, node, cls, label): each class in each tree, at the node of its value of the tree's own coordinate."""
    schema = "tree int, node bigint, cls bigint, label bigint"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                root = np.frombuffer(b"".join(batch.column("root").to_pylist()), np.uint32).reshape(n, trees)
                for t in range(trees):
                    node = _path(np.full(n, t, np.uint64), np.full(n, t % K), root[:, t])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), pa.array(node), batch.column("cls"), pa.nulls(n, pa.int64())], schema=shape)

    return classes.select("cls", "root").mapInArrow(run, schema)


def children(members: DataFrame) -> DataFrame:
    """(tree, node, cls, label) one level down, by each of the coordinates in ``ways``."""
    schema = "tree int, node bigint, cls bigint, label bigint"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, K)
                ways = batch.column("ways")
                row = np.repeat(np.arange(batch.num_rows), np.asarray(ways.value_lengths()))
                at = ways.flatten().to_numpy().astype(np.int64)
                node = _path(batch.column("node").to_numpy().view(np.uint64)[row], at, sig[row, at])
                take = lambda c, batch=batch, row=row: batch.column(c).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([take("tree"), pa.array(node), take("cls"), take("label")], schema=shape)

    return members.select("tree", "node", "cls", "label", "sig", "ways").mapInArrow(run, schema)


def agreement(threshold: float) -> int:
    """The fewest equal minwise values that a pair at the threshold has, but for five standard deviations."""
    return max(1, math.floor(K * threshold - 5 * math.sqrt(K * threshold * (1 - threshold))))


def similar(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Which rows of a may reach the threshold with which rows of b."""
    near = np.stack([(row == b).sum(1) for row in a]) >= least
    return near & (np.minimum(na[:, None], nb[None]) >= threshold * np.maximum(na[:, None], nb[None]) - 1e-9)


def forest(cls: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs in ``near``, by stars as far as possible."""
    out, free = [], near.any(1)
    for i in np.flatnonzero(free).tolist():
        if free[i]:
            free[i] = False
            todo = [i]
            while todo:
                x = todo.pop(0)
                for y in np.flatnonzero(near[x] & free).tolist():
                    free[y] = False
                    out.append((int(cls[x]), int(cls[y])))
                    todo.append(y)
    return out


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]: one by one if they are few, else by a product of incidence matrices."""
    if len(a) <= 20 * len(sets):
        out = np.zeros(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = sets[i], sets[j]
            out[k] = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()
        return out
    flat, size = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # hashes of one set alone are in no intersection
    owner, place = np.repeat(np.arange(len(sets)), size), place.ravel()
    kept = times[place] > 1
    owner, column = owner[kept], number[place[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for lo in range(0, int(number[-1]) + 1 if len(values) else 0, width):
        p, q = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[p:q], column[p:q] - lo] = 1
        total += x @ x.T
    return total[a, b].astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], kind: type = np.uint32) -> Iterator[dict[str, np.ndarray]]:
    """The members of one node after the other, from rows sorted by node."""
    rest: pa.Table | None = None

    def cut(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        node = table.column("node").to_numpy()
        ends = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        sizes = np.diff(ends)
        numbers = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("sig", "hashes")}
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, K)
        hashes = table.column("hashes").to_pylist() if "hashes" in table.column_names else None
        for k in np.flatnonzero(sizes > 1).tolist():
            a, b = int(ends[k]), int(ends[k + 1])
            yield {c: v[a:b] for c, v in numbers.items()} | {"sig": sig[a:b]} | ({"sets": [np.frombuffer(h, kind) for h in hashes[a:b]]} if hashes else {})

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        node = table.column("node").to_numpy()
        whole = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
        if whole:
            yield from cut(table.slice(0, whole))
        rest = table.slice(whole)
    if rest is not None and rest.num_rows:
        yield from cut(rest)


def by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition(parts(rows.sparkSession), "node").sortWithinPartitions("node", "cls")


def _pairs(found: list[tuple[int, int]] | np.ndarray, shape: pa.Schema) -> pa.RecordBatch:
    ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=shape)


def compare_leaves(leaves: DataFrame, threshold: float) -> DataFrame:
    """Spanning forests (a, b) of the candidates in small nodes (node, cls, n_shingles, sig)."""
    schema = "a bigint, b bigint"
    shape, least = arrow(schema), agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: set[tuple[int, int]] = set()
        for x in runs(batches):
            near = similar(x["sig"], x["n_shingles"], x["sig"], x["n_shingles"], threshold, least)
            np.fill_diagonal(near, False)
            got.update(forest(x["cls"], near))
            if len(got) > 100_000:
                yield _pairs(list(got), shape)
                got.clear()
        yield _pairs(list(got), shape)

    return by_node(leaves).mapInArrow(run, schema)


def unite(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Components of n members under pairs (a, b), by smallest member; and the pairs that joined two."""
    root, used = np.arange(len(near)), []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = root[i], root[j]
        if p != q:
            root[root == max(p, q)] = min(p, q)
            used.append(k)
    return root, used


def compare_sets(rows: DataFrame, percent: int, wide: bool, named: bool) -> DataFrame:
    """Groups (node, cls, n_shingles, sig, hashes) that fit a task, by their members' sets, of 64-bit hashes (``wide``) or 32-bit ones.

    ``named``: each member's component within the group (id, component). Else a spanning forest (a, b) of the pairs that pass.
    """
    schema = "id bigint, component bigint" if named else "a bigint, b bigint"
    shape, threshold = arrow(schema), percent / 100
    least = agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches, np.uint64 if wide else np.uint32):
            cls, n = x["cls"], x["n_shingles"]
            near = similar(x["sig"], n, x["sig"], n, threshold, least)
            np.fill_diagonal(near, False)
            a, b = np.nonzero(np.triu(near))
            both = common(x["sets"], a, b) if len(a) else np.zeros(0, np.int64)
            passes = 100 * both >= percent * (n[a] + n[b] - both)
            a, b = a[passes], b[passes]
            root, used = unite(near, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(cls[root])], schema=shape) if named else _pairs(np.column_stack([cls[a[used]], cls[b[used]]]), shape)

    out = by_node(rows).mapInArrow(run, schema)
    return out if named else out.distinct()


def compare_rows(pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the rows (node, a, b, na, nb, sa, sb) that may reach the threshold."""
    schema = "node bigint, a bigint, b bigint"
    shape, least = arrow(schema), agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = ((x == y).sum(1) >= least) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("node", "a", "b")], schema=shape)

    return pairs.select("node", "a", "b", "na", "nb", "sa", "sb").mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, renames: int = 0) -> DataFrame:
    """Rows of ``wanted`` (cls, twin, doc_id, more columns) with hashes and narrow, from the text of one of a class's documents each.

    Rows repeat where rows of documents do.
    """
    schema = "cls bigint, twin bigint, hashes binary, narrow binary"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in byte_slices(batches, most=1 << 20):
            sets, bounds = shingle_sets(data, offsets, width)
            own = [sets[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(np.diff(bounds)).tolist()]
            # The upper halves, in the same order: rising, with a repeat where two hashes share one.
            narrow = [(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets, bounds)), pa.array(set_keys(sets, bounds, TWIN)), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(narrow, pa.binary())], schema=shape)

    # The number of near-duplicates has no bound, so these joins shuffle at every size; broadcasts for small tables alone would hide what
    # large ones cost.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    # A doc_id may have rows of other classes as well; the last join drops those.
    return renamed(texts.mapInArrow(run, schema), renames).join(wanted.drop("doc_id").hint("merge"), ["cls", "twin"]).drop("twin")


def renamed(rows: DataFrame, times: int) -> DataFrame:
    """Other names for classes, of cls and twin, if two sets shared one."""
    return renamed(rows.withColumn("cls", F.when(F.col("cls").isNotNull(), F.xxhash64("cls", "twin"))), times - 1) if times else rows


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union. Each hub meets its partners in blocks, so no hub's list is one task."""
    spark, schema = pairs.sparkSession, "a bigint, b bigint"
    shape = arrow(schema)
    full = sets.select("cls", "hashes")
    blocks = pairs.join(pairs.groupBy("a").count(), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / BLOCK)).alias("block"))
    hubs = blocks.select("a", "block").distinct().join(full, F.col("a") == F.col("cls")).select("a", "block", F.lit(None).cast("bigint").alias("b"), "hashes")
    others = blocks.join(full, F.col("b") == F.col("cls")).select("a", "block", "b", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, h in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "hashes")), strict=True):
                x = np.frombuffer(h, np.uint64)
                if b is None:
                    hub = x
                    continue
                at = np.searchsorted(hub, x)
                both = int((hub[np.minimum(at, len(hub) - 1)] == x).sum())
                if 100 * both >= percent * (len(hub) + len(x) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=shape)

    return hubs.unionByName(others).repartition(parts(spark), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(run, schema)


def _sized(scratch: Scratch, frontier: DataFrame, name: str) -> DataFrame:
    """Members of nodes that have two or more, not all of one label, with the node's size."""
    frontier = scratch.write(frontier, f"frontier-{name}")
    mixed = (F.count("label") < F.count(F.lit(1))) | (F.min("label") < F.max("label"))
    sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size"), mixed.alias("mixed")).where("size > 1 and mixed").drop("mixed")
    out = scratch.write(frontier.join(sizes, "node"), f"nodes-{name}")
    scratch.drop(f"frontier-{name}")
    return out


def ways(sig: np.ndarray, seed: int) -> list[int]:
    """Coordinates by which a node branches, given values of some of its members."""
    n = len(sig)
    ranked = np.sort(sig, axis=0)
    change = np.ones((n + 1, K), bool)
    change[1:-1] = ranked[1:] != ranked[:-1]
    chance = np.zeros(K)
    for k in range(K):
        size = np.diff(np.flatnonzero(change[:, k]))
        chance[k] = (size * (size - 1)).sum() / max(1, n * (n - 1))
    order = np.random.default_rng(seed).permutation(K)
    order = order[np.argsort(chance[order] > 0.9, kind="stable")]  # those that nearly all agree on come last
    if chance[order[LEAST_WAYS - 1]] > 0.9:
        order = np.argsort(chance, kind="stable")
    n = next((k for k in range(WAYS, LEAST_WAYS, -1) if chance[order[:k]].sum() <= WORK), LEAST_WAYS)
    return order[:n].tolist()


def _probe(scratch: Scratch, large: DataFrame, facts: DataFrame, threshold: float, name: str) -> DataFrame:
    """For each large node, from about PROBE members: (node, hub, ways). The hub is null if few are alike that aren't known to be."""
    schema, least = "node bigint, hub bigint, ways array<int>", agreement(threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", ignore_index=True)
        sig, n = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, K), pdf["n_shingles"].to_numpy()
        label = np.where(pdf["label"].isna(), pdf["cls"], pdf["label"].fillna(0)).astype(np.int64)
        new = (similar(sig, n, sig, n, threshold, least) & (label[:, None] != label[None])).sum(1)
        # Of those that are alike with nearly as many as any, the first: the same one in most nodes of a family, so links repeat.
        hub = int(pdf["cls"][int((new >= 0.8 * new.max()).argmax())]) if new.max() >= max(1, 0.05 * len(pdf)) else None
        node = int(pdf["node"][0])
        return pd.DataFrame({"node": [node], "hub": pd.array([hub], "Int64"), "ways": [ways(sig, node & 0xFFFFFFFF)]})

    some = large.where(F.abs(F.xxhash64("cls") / F.lit(2.0**63)) * F.col("size") < PROBE)
    return scratch.write(some.join(facts, "cls").select("node", "cls", "label", "n_shingles", "sig").groupBy("node").applyInPandas(run, schema), f"probe-{name}")


def _star(scratch: Scratch, large: DataFrame, facts: DataFrame, threshold: float, name: str) -> DataFrame:
    """Candidates (node, a, b) among a large node's hub a and all others."""
    ends = large.select("node", F.col("hub").alias("a"), F.col("cls").alias("b")).where("a <> b")
    side = lambda c: facts.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    return scratch.write(compare_rows(ends.join(side("a"), "a").join(side("b"), "b"), threshold), f"star-{name}")


def _labelled(scratch: Scratch, large: DataFrame, star: DataFrame, name: str) -> DataFrame:
    """All members of large nodes but the hub, labelled anew by it if they joined it, with the node's most frequent label (``known``), how
    many have it (``most``), and how many don't (``others``). Nodes with one label are done."""
    joined = star.select("node", F.col("b").alias("cls"), F.col("a").alias("new"))
    rest = large.where("hub is null or cls <> hub").join(joined, ["node", "cls"], "left").select("tree", "node", "cls", F.coalesce("new", "label").alias("label"), "ways")
    rest = scratch.write(rest, f"rest-{name}")
    return rest.join(_tops(rest).where("others > 0"), "node")


def _tops(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("top"))
    most = F.coalesce(F.col("top.n"), F.lit(0))
    return tops.select("node", F.col("top.label").alias("known"), most.alias("most"), (F.col("size") - most).alias("others"))


def _cells(rows: DataFrame, leaf: int) -> DataFrame:
    """Groups (node, cls, label, known, most, others, more columns) as cells of two blocks each, so that all pairs of members meet in one,
    but for those that both have the group's most frequent label: they are known to be of one family."""
    blocks = lambda c: F.ceil(F.col(c) / leaf).cast("int")
    rows = rows.where("others > 0").withColumns({"n_known": blocks("most"), "n_open": blocks("others"), "is_known": F.coalesce(F.col("label") == F.col("known"), F.lit(False))})
    place = lambda n: F.pmod(F.xxhash64("cls"), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("is_known"), F.col("n_open") + place("n_known")).otherwise(place("n_open")))
    reach = F.col("n_open") - 1 + F.when(F.col("is_known"), 0).otherwise(F.col("n_known"))
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), reach)))
    each = each.withColumn("node", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")))
    return each.drop("known", "most", "others", "n_known", "n_open", "is_known", "block", "other", "label")


def _candidates(scratch: Scratch, facts: DataFrame, nodes: DataFrame, threshold: float, leaf: int, levels: int) -> DataFrame:
    """Candidate pairs (a, b) that span every family."""
    lead = lambda x: x.join(facts, "cls").select("node", "cls", "n_shingles", "sig")
    leaves = lambda x: compare_leaves(lead(x.where(F.col("size") <= leaf).select("node", "cls")), threshold)
    pairs = leaves(nodes)
    level, large = 0, nodes.where(F.col("size") > leaf)
    if large.limit(1).count():  # all further levels need only these
        some = scratch.write(facts.join(large.select("cls").distinct(), "cls", "left_semi"), "facts")
        lead = lambda x: x.join(some, "cls").select("node", "cls", "n_shingles", "sig")
    while large.limit(1).count():
        large = large.join(_probe(scratch, large, some, threshold, str(level)), "node")
        star = _star(scratch, large.where("hub is not null"), some, threshold, str(level))
        pairs = pairs.unionByName(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        rest = _labelled(scratch, large, star, str(level))
        last = F.lit(True) if level == levels else F.col("others") <= FEW * leaf
        cells = _cells(rest.where(last).select("node", "cls", "label", "known", "most", "others"), leaf)
        pairs = pairs.unionByName(compare_leaves(lead(cells), threshold))
        level += 1
        if level > levels:
            break
        below = _sized(scratch, children(rest.where(~last).join(some, "cls")), str(level))
        pairs = pairs.unionByName(leaves(below))
        large = below.where(F.col("size") > leaf)
    out = scratch.write(pairs.distinct(), "pairs")
    for k in range(level + 1):
        for done in ("nodes", "rest", "star", "probe"):
            scratch.drop(f"{done}-{k}")
    return out


def _large_families(scratch: Scratch, facts: DataFrame, candidates: DataFrame, families: DataFrame, sets: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Components (id, component) within families (node, size, cls) that exceed a task."""
    most, known = leaf * BLOCKS, None
    whole = families.where(F.col("size") <= most).select("node", "cls", F.lit(None).cast("bigint").alias("label"))
    if (giant := families.where(F.col("size") > most)).limit(1).count():
        known = scratch.write(confirm(candidates.join(giant.select(F.col("cls").alias("a")), "a", "left_semi"), sets, percent), "known")
        labels = components(scratch, known, "known-components").select(F.col("id").alias("cls"), F.col("component").alias("label"))
        whole = whole.unionByName(giant.select("node", "cls").join(labels, "cls", "left").select("node", "cls", "label"))
    groups = _cells(whole.join(_tops(whole), "node"), leaf)
    of = lambda c: groups.join(facts, "cls").join(sets.select("cls", F.col(c).alias("hashes")), "cls").select("node", "cls", "n_shingles", "sig", "hashes")
    pairs = scratch.write(compare_sets(of("narrow"), percent, wide=False, named=False), "large")
    links = scratch.write(confirm(pairs, sets, percent), "confirmed")
    if links.count() < pairs.count():  # 32-bit hashes met by chance; a pair that hid behind such a one would be lost
        links = compare_sets(of("hashes"), percent, wide=True, named=False)
    links = links.unionByName(known) if known is not None else links
    return components(scratch, links, "large-components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept, class_id (rows with equal sets share it),
    group_id (rows that links connect share it; unlike doc_ids it is unique to them) and text_hash (xxhash64 of the text)."""
    threshold, scratch = percent / 100, Scratch(docs.sparkSession, "minhash")
    rows, renames = scratch.write(signatures(docs, width, trees), "rows"), 0
    while True:
        some = renamed(rows, renames).where("cls is not null and doc_id is not null")
        first = [F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("n_shingles", "sig", "root", "twin")], (F.min("twin") < F.max("twin")).alias("shared")]
        classes = scratch.write(some.groupBy("cls").agg(*first), f"classes-{renames}")
        if not classes.where("shared").limit(1).count():
            break
        renames += 1  # two sets share a name
    rows = renamed(rows, renames)
    facts = classes.select("cls", "n_shingles", "sig")
    nodes = _sized(scratch, roots(classes, trees), "0")
    pairs = _candidates(scratch, facts, nodes, threshold, leaf, levels)
    members = components(scratch, pairs, "families").select(F.col("id").alias("cls"), F.col("component").alias("node"))
    members = scratch.write(members.join(members.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "node"), "members")
    wanted = scratch.write(classes.select("cls", "twin", "doc_id", "n_shingles", "sig").join(members, "cls"), "wanted")
    sets = scratch.write(full_sets(docs, wanted, width, renames), "sets")
    if sets.count() > wanted.count():
        sets = scratch.write(sets.dropDuplicates(["cls"]), "sets-once")
    small = sets.where(F.col("size") <= leaf).select("node", "cls", "n_shingles", "sig", "hashes")
    found = compare_sets(small, percent, wide=True, named=True)
    if (large := members.where(F.col("size") > leaf)).limit(1).count():
        found = found.unionByName(_large_families(scratch, facts, pairs, large, sets, percent, leaf))
    found = found.withColumnRenamed("id", "cls")

    named = classes.select("cls", "doc_id").join(found, "cls", "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("group_id"))
    lowest = named.groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    named = scratch.write(named.join(lowest, "group_id").select("cls", "group_id", "component_id"), "named")
    out = rows.drop("sig", "root", "twin").join(named, "cls", "left")
    first = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), F.col("group_id"))
    return out.select("doc_id", "n_shingles", first.cast("bigint").alias("component_id"), F.coalesce(F.col("doc_id") == first, F.lit(True)).alias("kept"), F.col("cls").alias("class_id"), group.alias("group_id"), "text_hash")
