"""Removal of repeated byte strings by a family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or in the same one
before. Strings are judged on the input. Sorting every suffix of the corpus would be wasteful, since hardly any repeats, so:

1. Each string of LENGTH bytes has an anchor, the smallest hash among its ``GRAM``-byte grams. Equal strings have equal anchors at
   equal places, and neighbouring strings mostly share one, so an anchor stands for a run of strings (its segment).
2. Anchors meet by their gram's hash. One without a partner is unique, and so are its strings. Of equal segments all but the
   earliest go at once. A task drops the repeats within its own slice before it sends anything, so a passage that very many
   documents hold is sent once per slice.
3. Different segments under one gram are fetched and dealt into shards by that gram; if very many share it, their segments are cut
   into short ones and dealt by the bytes common to their strings. A shard reads its strings in document order, in batches. Each
   batch is sorted to a suffix array, scanned against the levels of the shard's index for equal prefixes of LENGTH bytes, and
   added as a new level; levels of like size are merged, so there are logarithmically many.

Hashes have 64 bits each for gram and segment, both of which must agree in step 2; step 3 compares bytes.

Null text counts as empty. Texts shorter than LENGTH lose nothing. Rows that share a doc_id are read as one document whose rows'
order is that of their texts' hashes; null ids come first. Repeated rows are repeats like any other. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, byte_slices, parts
from .minhash import ODD, mix

LENGTH, GRAM = 100, 20
#: Strings in a shard of the index, about; segments under one gram from which they are dealt by content, and strings in each then.
SHARD, MANY, SHORT = 300_000, 1_000, 4
BATCH = 50_000


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse, modulo 2^64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64), dtype=np.uint64)]) for x in (ODD, pow(ODD, -1, 1 << 64)))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(1 << max(20, len(data).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from a to b."""
    _, down = powers(1 << max(20, len(sums).bit_length()))
    return mix((sums[b] - sums[a]) * down[a])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each anchor its document, place, first and last string's start, the gram's hash and the segment's."""
    n, none = len(data), np.zeros(0, np.int64)
    wide = length - gram + 1
    if n < length:
        return (none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    sums = prefix_sums(data)
    grams = np.arange(n - gram + 1)
    h = span_hash(sums, grams, grams + gram)
    # The smallest of each ``wide`` in a row: within blocks, minima up to and from each place.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    blocks = -(-len(key) // wide)
    full = np.full(blocks * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(key)] = key
    full = full.reshape(blocks, wide)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - length + 1
    best = (np.minimum(back[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    inside = np.flatnonzero(np.arange(starts) + length <= offsets[1:][doc])
    best, doc = best[inside], doc[inside]
    if not len(best):
        return (none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = inside[new], inside[np.append(new[1:], len(best)) - 1]
    at, doc = best[new], doc[new]
    segment = mix(span_hash(sums, first, last + length) + ((at - first) * 256 + last - first).astype(np.uint64))
    return doc, at, first, last, h[at], segment


class Index:
    """Suffix arrays, each of about twice the size of the next, over strings of one length."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, strings: np.ndarray) -> np.ndarray:
        """Strings in order of their places; which of them occurred before."""
        order = np.argsort(strings, kind="stable")
        array = strings[order]
        again = np.zeros(len(array), bool)
        again[1:] = array[1:] == array[:-1]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, array), len(level) - 1)
            again |= level[at] == array
        out = np.zeros(len(array), bool)
        out[order] = again
        fresh = array[~again]
        while len(fresh) and self.levels and len(self.levels[-1]) < 2 * len(fresh):
            both = np.concatenate([self.levels.pop(), fresh])
            both.sort(kind="stable")  # two runs, so this is a merge
            fresh = both
        if len(fresh):
            self.levels.append(fresh)
        return out


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins spans of sorted (doc, start) that overlap or touch."""
    if not len(doc):
        return doc, start, end
    top, cut = end.copy(), np.ones(len(doc), bool)
    shift = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1])])) << 40
    top = np.maximum.accumulate(end + shift) - shift
    cut[1:] = (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])
    first = np.flatnonzero(cut)
    return doc[first], start[first], top[np.append(first[1:], len(doc)) - 1]


ROWS = "row bigint, kind string, gram bigint, segment bigint, at bigint, first bigint, last bigint"


def _marks(docs: DataFrame, length: int) -> DataFrame:
    """From slices of documents: kind ``anchor``, one for each segment, and kind ``gone``, segments that a slice repeats."""
    shape = arrow(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in byte_slices(batches, most=1 << 20):
            doc, at, first, last, gram, segment = anchors(data, offsets, length)
            row = part.column("row").to_numpy()[doc]
            base = offsets[doc]
            order = np.lexsort((first - base, row, segment, gram))
            g, s = gram[order], segment[order]
            gone = np.zeros(len(order), bool)
            gone[order[1:]] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
            kind = pa.array(np.where(gone, "gone", "anchor"))
            columns = [pa.array(row), kind, pa.array(gram.view(np.int64)), pa.array(segment.view(np.int64)), *(pa.array(x - base) for x in (at, first, last))]
            yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return docs.mapInArrow(run, ROWS)


def _meet(marks: DataFrame) -> DataFrame:
    """Anchors by gram: ``gone`` for all but the earliest of equal segments, ``open`` for the earliest where segments differ."""
    shape = arrow(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def decide(t: pa.Table) -> pa.RecordBatch:
            gram, segment = t.column("gram").to_numpy(), t.column("segment").to_numpy()
            same_gram = gram[1:] == gram[:-1]
            again = np.concatenate([[False], same_gram & (segment[1:] == segment[:-1])])
            head = np.flatnonzero(np.concatenate([[True], ~same_gram]))
            kinds = np.add.reduceat(~again, head)
            several = np.repeat(kinds > 1, np.diff(np.append(head, len(gram))))
            keep = np.flatnonzero(again | several)
            t = t.take(pa.array(keep)).combine_chunks()
            kind = pa.array(np.where(again[keep], "gone", "open"), pa.string())
            return pa.RecordBatch.from_arrays([kind if c == "kind" else t.column(c).combine_chunks() if t.num_rows else pa.array([], shape.field(c).type) for c in shape.names], schema=shape)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            gram = table.column("gram").to_numpy()
            ends = np.flatnonzero(gram != gram[-1])  # the last gram may go on in the next batch
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield decide(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield decide(rest)

    met = marks.repartition(parts(marks.sparkSession), "gram").sortWithinPartitions("gram", "segment", "row", "first")
    return met.select(*ROWS.replace(" bigint", "").replace(" string", "").split(", ")).mapInArrow(run, ROWS)


def _segments(work: DataFrame, length: int) -> DataFrame:
    """Bytes of the open segments (key, row, start, data), those of crowded grams in short pieces under their common bytes' hash."""
    schema = "key bigint, row bigint, start bigint, data binary"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in byte_slices(batches):
            key, row, start, out = [], [], [], []
            rows = part.column("row").to_pylist()
            text = data.tobytes()
            for i, found in enumerate(part.column("found").to_pylist()):
                base = int(offsets[i])
                for x in found:
                    if not x["crowded"]:
                        pieces = [(x["gram"], x["first"], x["last"])]
                    else:  # pieces are aligned to the anchor, so equal strings fall into like pieces
                        pieces, a = [], x["at"]
                        for o in range((a - x["last"]) // SHORT * SHORT, a - x["first"] + 1, SHORT):
                            lo, hi = max(x["first"], a - o - SHORT + 1), min(x["last"], a - o)
                            both = text[base + a - o : base + a - o - SHORT + 1 + length]  # what all strings of a full piece share
                            pieces.append((int.from_bytes(hashlib.blake2b(both, digest_size=8, key=o.to_bytes(2, "little")).digest(), "little", signed=True), lo, hi))
                    for k, lo, hi in pieces:
                        key.append(k)
                        row.append(rows[i])
                        start.append(lo)
                        out.append(text[base + lo : base + hi + length])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(out, pa.binary())], schema=shape)

    return work.mapInArrow(run, schema)


def _scan(segments: DataFrame, shards: int, length: int) -> DataFrame:
    """Spans (row, start, end) of strings that occurred before, by shard and then in document order."""
    schema = "row bigint, start bigint, end bigint"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, held, size = Index(), None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                strings, rows, starts = [], [], []
                for r, s, d in held:
                    x = np.lib.stride_tricks.sliding_window_view(np.frombuffer(d, np.uint8), length)
                    strings.append(x)
                    rows.append(np.full(len(x), r))
                    starts.append(s + np.arange(len(x)))
                held, size = [], 0
                row, start = np.concatenate(rows), np.concatenate(starts)
                again = index.add(np.ascontiguousarray(np.concatenate(strings)).view(f"S{length}").ravel())
                row, start = row[again], start[again]
                order = np.lexsort((start, row))
                row, start, end = _spans(row[order], start[order], start[order] + length)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(start), pa.array(end)], schema=shape)

        for batch in batches:
            for shard, r, s, d in zip(*(batch.column(c).to_pylist() for c in ("shard", "row", "start", "data")), strict=True):
                if shard != now:
                    yield from flush()
                    index, now = Index(), shard
                held.append((r, s, d))
                size += len(d) - length + 1
                if size >= BATCH:
                    yield from flush()
        yield from flush()

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.repartition(max(parts(segments.sparkSession), min(shards, 100_000)), "shard").sortWithinPartitions("shard", "row", "start").select("shard", "row", "start", "data").mapInArrow(run, schema)


def _finish(rows: DataFrame) -> DataFrame:
    """Cuts spans (found: start, end) out of whole texts."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in byte_slices(batches):
            n = part.num_rows
            removed, spans, sha, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for i, found in enumerate(part.column("found").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                if found:
                    x = np.array(sorted((f["start"], f["end"]) for f in found), np.int64)
                    _, a, b = _spans(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
                    gone = np.zeros(len(text) + 1, np.int64)
                    np.add.at(gone, a, 1)
                    np.add.at(gone, b, -1)
                    text = text[np.cumsum(gone)[:-1] == 0]
                    removed[i], spans[i] = (b - a).sum(), len(a)
                kept.append(text.tobytes())
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(sha), pa.array(kept, pa.binary())], schema=shape)

    return rows.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes left)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # Each row's place in the order of documents. Ids mostly are their own places; if not (nulls, repeats), rows are numbered.
    unclear = base.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    base = _numbered(scratch, base) if unclear else base.withColumn("row", F.col("doc_id"))
    marks = scratch.write(_marks(base.select("row", "text"), length), "marks", ["kind"])
    met = scratch.write(_meet(marks.where("kind = 'anchor'")), "met", ["kind"])
    gone = marks.where("kind = 'gone'").unionByName(met.where("kind = 'gone'")).select("row", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    opened = met.where("kind = 'open'").select("row", "gram", "at", "first", "last")
    crowded = opened.groupBy("gram").count().where(F.col("count") > many).select("gram", F.lit(True).alias("crowded"))
    opened = opened.join(crowded, "gram", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    per_row = opened.groupBy("row").agg(F.collect_list(F.struct("gram", "at", "first", "last", "crowded")).alias("found"))
    segments = scratch.write(_segments(base.select("row", "text").join(per_row, "row"), length), "segments")
    total = segments.agg(F.sum(F.octet_length("data") - (length - 1))).first()[0] or 0
    more = scratch.write(_scan(segments, max(1, -(-int(total) // SHARD)), length), "spans")
    scratch.drop("segments")
    all_spans = gone.unionByName(more).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return _finish(base.join(all_spans, "row", "left").select("doc_id", "text", "found"))


def _numbered(scratch: Scratch, base: DataFrame) -> DataFrame:
    """Numbers rows by doc_id and then by text hash: ranges of ids, and within a range a running number."""
    from pyspark.sql import Window

    keyed = base.withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(parts(scratch.spark), F.col("doc_id").asc_nulls_first(), "h").withColumn("p", F.spark_partition_id())
    ranged = scratch.write(ranged, "numbered")
    return ranged.withColumn("row", F.shiftleft(F.col("p").cast("bigint"), 40) + F.row_number().over(Window.partitionBy("p").orderBy(F.col("doc_id").asc_nulls_first(), "h"))).drop("p", "h")
