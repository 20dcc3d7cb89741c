"""Token-id archive with a canonical, length-limited Huffman code.

Ids are counted over all documents; package-merge gives code lengths of at most ``LIMIT`` bits (or what a larger vocabulary needs), and
lengths alone fix the canonical code. Documents are range-partitioned by id, and each partition writes segments: a header, the documents' ids and
numbers of tokens, the bit offset of every block of ``BLOCK`` ids, and the code bits. Blocks decode on their own, by a table over
the next ``LIMIT`` bits, so a segment's blocks are decoded in step with one another.

A segment is one row of a Parquet table, because Spark's writers reach every store and commit tasks safely. Layout, little-endian:
``KTH1``, uint32 documents, uint64 ids, uint32 blocks; int64 doc_id each; uint32 tokens each; uint64 bit offset each; code words
as big-endian uint32. The table ``code`` holds one length per id.

Null text counts as empty: the end id alone. Null ids come first. Repeated ids are kept, in order of their numbers of tokens and then
of a hash of their contents, and don't meet in one range if there are many. An empty table gives an archive without segments. Extra
columns don't matter, whatever their names. A text of any length is encoded whole, in one worker's memory.

An archive is written below a :class:`~.common.Scratch`, which goes with the session, or a :class:`~.common.Folder`, which stays for
later readers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow, binary_rows, byte_slices
from .tokens import crc32, encoder, vocabulary

LIMIT, BLOCK, SEGMENT = 18, 256, 1 << 20
MAGIC = b"KTH1"
#: Ids that a partition of the archive gets, about.
PARTITION_IDS = 16 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: lengths of at most ``limit`` bits with the least sum of count times length. 0: the id doesn't occur."""
    out = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) < 2:
        out[ids] = 1
        return out
    limit = max(limit, (len(ids) - 1).bit_length())
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.int64)
    n, levels, now = len(order), [], weight
    for _ in range(limit - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        place = np.argsort(both, kind="stable")
        levels.append(place)
        now = both[place]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for place in reversed(levels):
        chosen = place[:take]
        leaves = int((chosen < n).sum())  # of equal weights leaves come first, so they are a prefix in order
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length and then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for size in range(1, int(lengths.max(initial=0)) + 1):
        of = used[lengths[used] == size]
        code <<= size - last
        last = size
        codes[of] = code + np.arange(len(of), dtype=np.uint64)
        code += len(of)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of code bits, and the bit offset of each block."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    value = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    n = int(end[-1] >> 5) + 2 if len(end) else 1
    words = np.bincount(at >> 5, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount((at >> 5) + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return words.astype(np.uint64).astype(">u4"), at[::BLOCK]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.limit = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths)
        self.ids, self.sizes = np.zeros(1 << self.limit, np.uint32), np.zeros(1 << self.limit, np.int64)
        used = np.flatnonzero(lengths)
        size = lengths[used].astype(np.int64)
        first, span = codes[used].astype(np.int64) << (self.limit - size), np.int64(1) << (self.limit - size)
        place = np.repeat(first - np.cumsum(span) + span, span) + np.arange(int(span.sum()))
        self.ids[place], self.sizes[place] = np.repeat(used, span), np.repeat(size, span)

    def decode(self, words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
        """All blocks in step: each reads its next code by one look into the table."""
        w = np.append(words.astype(np.uint64), np.uint64(0))
        at, out = blocks.astype(np.int64).copy(), np.zeros((len(blocks), BLOCK), np.uint32)
        last = n - (len(blocks) - 1) * BLOCK
        for j in range(min(BLOCK, n)):
            if j == last:
                at = at[:-1]
            k = at >> 5
            look = ((w[k] << np.uint64(32) | w[k + 1]) << (at & 31).astype(np.uint64)) >> np.uint64(64 - self.limit)
            out[: len(at), j] = self.ids[look]
            at = at + self.sizes[look]
        return out.ravel()[:n]


def write_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    words, blocks = encode_bits(ids, lengths, codes)
    head = MAGIC + np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + np.array([len(blocks)], "<u4").tobytes()
    return head + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + blocks.astype("<u8").tobytes() + words.tobytes()


def read_segment(data: bytes, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, numbers of tokens, all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of this archive")
    docs, n, blocks = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u8", 1, 8)[0]), int(np.frombuffer(data, "<u4", 1, 16)[0])
    at = 20
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    places = np.frombuffer(data, "<u8", blocks, at + 12 * docs)
    words = np.frombuffer(data, ">u4", -1, at + 12 * docs + 8 * blocks)
    return doc_ids, counts, decoder.decode(words, places, n)


def tokenised(docs: DataFrame, end_id: int, path: str) -> DataFrame:
    """Rows of kind ``ids``: a document's tokens, as uint16 if the vocabulary allows; of kind ``count``: an id and how often a task met it."""
    schema = "kind string, doc_id bigint, n bigint, ids binary"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, enc = shape, encoder(path)
        counts, width = np.zeros(max(enc.size, end_id + 1), np.int64), np.uint16 if max(enc.size, end_id + 1) <= 1 << 16 else np.uint32
        for part, _, _ in byte_slices(batches):
            ids, bounds = enc.encode_ended([t or "" for t in part.column("text").to_pylist()], end_id)
            counts += np.bincount(ids, minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(["ids"] * part.num_rows), part.column("doc_id"), pa.array(np.diff(bounds)), binary_rows(ids.astype(width), bounds)], schema=to)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(["count"] * len(met), pa.string()), pa.array(met), pa.array(counts[met]), pa.nulls(len(met), pa.binary())], schema=to)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def write_archive(scratch: Scratch, docs: DataFrame, end_id: int = 1, path: str | None = None) -> None:
    """Writes the tables ``code`` and ``segments`` below ``scratch``, with documents in ascending order of doc_id."""
    spark, path = docs.sparkSession, path or vocabulary()
    table = scratch.write(tokenised(docs, end_id, path), "tokens", ["kind"])
    # One row per id of the vocabulary at most, whatever the corpus.
    met = table.where("kind = 'count'").groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(met["doc_id"].max()) + 1 if len(met) else 1, np.int64)
    counts[met["doc_id"].to_numpy(np.int64)] = met["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(scratch.path("code"))
    wide = "<u2" if max(len(counts), encoder(path).size) <= 1 << 16 else "<u4"
    schema = "shard int, seq int, n_ids bigint, segment binary"
    shipped = spark.sparkContext.broadcast(lengths)  # one byte per id of the vocabulary
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to, lengths, shard, seq = shape, shipped.value, TaskContext.get().partitionId(), 0
        codes = canonical(lengths)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            if held:
                d, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([write_segment(d, n, ids, lengths, codes)], pa.binary())], schema=to)
                seq += 1

        for part, data, _ in byte_slices(batches, "ids"):
            d = part.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            held.append((d, part.column("n").to_numpy(), np.frombuffer(data.tobytes(), wide).astype(np.uint32)))
            if sum(len(x[2]) for x in held) >= SEGMENT:
                yield from flush()
        yield from flush()

    order = [F.col("doc_id").asc_nulls_first(), "n", "h"]
    ids = table.where("kind = 'ids'").select("doc_id", "n", F.xxhash64("ids").alias("h"), "ids")
    total = int(counts.sum())
    ranged = ids.repartitionByRange(max(1, min(-(-total // PARTITION_IDS) * 4, 100_000)), *order)
    ranged.sortWithinPartitions(*order, "ids").select("doc_id", "n", "ids").mapInArrow(run, schema).write.option("compression", "none").parquet(scratch.path("segments"))
    scratch.drop("tokens")


def read_archive(spark: SparkSession, root: Scratch, with_ids: bool = True) -> DataFrame:
    """From the archive alone, per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    lengths = np.frombuffer(bytes(spark.read.parquet(root.path("code")).first()["lengths"]), np.uint8)
    shipped = spark.sparkContext.broadcast(lengths)
    table = spark.read.schema("shard int, seq int, n_ids bigint, segment binary").parquet(root.path("segments"))
    # The number of segments is that of ids over SEGMENT; starts within a shard by a window, of shards by their (few) sums.
    per_shard = sorted(table.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for shard, n in per_shard:
        rows.append((shard, before))
        before += n
    shards = spark.createDataFrame(rows, "shard int, shard_start bigint")
    seqs = table.select("shard", "seq", "n_ids").withColumn("within", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids"))
    starts = seqs.join(F.broadcast(shards), "shard").select("shard", "seq", (F.col("shard_start") + F.col("within")).alias("first"))
    schema = "shard int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, decoder = shape, Decoder(shipped.value)
        for batch in batches:
            for shard, seq, segment in zip(*(batch.column(k).to_pylist() for k in ("shard", "seq", "segment")), strict=True):
                d, n, ids = read_segment(segment, decoder)
                bounds = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
                crc = np.fromiter((crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), np.int64, len(n))
                k = len(n)
                low = np.iinfo(np.int64).min
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard), pa.int32()), pa.array(np.full(k, seq), pa.int32()), pa.array(d, mask=d == low), pa.array(bounds[:-1]), pa.array(n.astype(np.int64)), pa.array(crc), *lists], schema=to)

    out = table.select("shard", "seq", "segment").mapInArrow(run, schema)
    return out.join(starts, ["shard", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
