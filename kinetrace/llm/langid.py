"""Language identification by nearest centroids.

A text's features are its byte bigrams and trigrams over whole, case-folded text with all but letters as blanks, hashed to
``WIDTH`` numbers, damped by a logarithm, weighted by inverse document frequency and normalised. The labelled sample of each
language is clustered by spherical k-means; a text takes the language of the centroid with the largest cosine. It is rejected if
that cosine is below ``MOST`` and far below what the sample showed at the text's length: for texts of 2^b to 2^(b+1) n-grams,
``SLACK`` times the smallest.

The model is fitted on a bounded sample: at most about ``SAMPLE`` labelled rows, spread evenly over languages and picked by a hash
of their id. Of more than ``LANGUAGES`` values of lang the most frequent are learned. So its size doesn't depend on the corpus. The
driver holds the sample's counts as they occur, and dense vectors of one language at a time.
Prediction is a map over whole texts. A text's counts are summed up in windows of ``WINDOW`` bytes, so a long text takes no more memory
than its own bytes; a row's counts take ``WIDTH`` numbers whatever its length, so a worker holds those of ``ROWS`` rows at most.

Null text, or text without a letter: ``und``, score 0, rejected. A text with letters always gets a learned language, however far
it lies. Without any labelled row nothing can be learned: all are ``und``, and only texts without letters are rejected. Ties go to the language first in order. Repeated rows
are predicted alike. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, byte_slices, map_rows, released

WIDTH, SAMPLE, CLUSTERS, SLACK, MOST = 4096, 4000, 6, 0.6, 0.3
LANGUAGES = 1000
UND, BLOCK, SLICE, ROWS, WINDOW = "und", 128, 1 << 19, 256, 1 << 20


def _folding() -> np.ndarray:
    """ASCII letters to lower case, other ASCII to blanks, other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for c in range(97, 123):
        t[c] = t[c - 32] = c
    return t


FOLD = _folding()


def _counted(places: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(places, minlength=n).astype(np.int32)


def _folded(data: np.ndarray) -> np.ndarray:
    x = FOLD[data]
    if len(x) > 1:  # capital letters of the Latin-1 block, as UTF-8
        big = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
        x[big] += 0x20
    return x


def _long(data: np.ndarray) -> np.ndarray:
    """:func:`features` of one text, summed up over windows."""
    y = np.concatenate([[32], _folded(data), [32]]).astype(np.uint8)
    y = y[np.concatenate([[True], (y[1:] != 32) | (y[:-1] != 32)])]
    out = np.zeros(WIDTH, np.int64)
    for a in range(0, len(y), WINDOW):
        z = y[a : a + WINDOW + 2].astype(np.uint32)
        two = (z[:-1] << 8) | z[1:]
        out += np.bincount((two[:WINDOW] * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=WIDTH)
        if len(z) > 2:
            out += np.bincount(1024 + (((two[:-1] << 8 | z[2:])[:WINDOW] * np.uint32(0x85EBCA6B)) >> np.uint32(16)) % (WIDTH - 1024), minlength=WIDTH)
    return out[None]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row per text. Blocks of texts bound the memory beside the result."""
    n = len(offsets) - 1
    if n > BLOCK:
        cuts = range(0, n, BLOCK)
        return np.concatenate([features(data[offsets[i] : offsets[min(n, i + BLOCK)]], offsets[i : i + BLOCK + 1] - offsets[i]) for i in cuts])
    if n == 1 and len(data) > WINDOW:
        return _long(data)
    x = _folded(data)
    # Texts are parted by a blank on either side, so no n-gram spans two of them.
    size = np.diff(offsets) + 2
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    y = np.full(int(size.sum()), 32, np.uint32)
    at = np.ones(len(y), bool)
    at[begin] = at[begin + size - 1] = False
    y[at] = x
    keep = np.ones(len(y), bool)  # runs of blanks count as one
    keep[1:] = (y[1:] != 32) | (y[:-1] != 32) | (row[1:] != row[:-1])
    y, row = y[keep], row[keep]
    out = np.zeros(n * WIDTH, np.int32)
    two = (y[:-1] << 8) | y[1:]
    same = row[:-1] == row[1:]
    hashed = (two * np.uint32(0x9E3779B1)) >> np.uint32(22)
    out += _counted((row[:-1].astype(np.int64) * WIDTH + hashed)[same], len(out))
    if len(y) > 2:
        hashed = 1024 + (((two[:-1] << 8 | y[2:]) * np.uint32(0x85EBCA6B)) >> np.uint32(16)) % (WIDTH - 1024)
        out += _counted((row[:-2].astype(np.int64) * WIDTH + hashed)[row[:-2] == row[2:]], len(out))
    return out.reshape(n, WIDTH)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray  # each centroid's language
    limits: np.ndarray  # by the logarithm of the number of n-grams

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language, cosine, whether rejected."""
        cosines = vectors(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return self.of[best], score, score < self.limits[buckets(counts, len(self.limits))]


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def buckets(counts: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)).astype(np.int64), n - 1)


class Sample:
    """Counts of n-grams of a sample's rows, of which only those that occur are held. Rows are made dense as they are asked for."""

    def __init__(self, places: list[bytes], counts: list[bytes]):
        self.bounds = np.cumsum([0, *(len(p) // 2 for p in places)])
        self.places, self.counts = np.frombuffer(b"".join(places), "<u2"), np.frombuffer(b"".join(counts), "<u4")

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), WIDTH), np.int64)
        for row, i in zip(out, rows.tolist(), strict=True):
            a, b = self.bounds[i], self.bounds[i + 1]
            row[self.places[a:b]] = self.counts[a:b]
        return out


def fit(counts: np.ndarray | Sample, labels: list[str], clusters: int = CLUSTERS) -> Model | None:
    """The model of rows of counts. Only one language's rows are held as dense vectors at a time."""
    n = len(counts)
    if not n:
        return None
    languages = tuple(sorted(set(labels)))
    blocks = lambda rows: (rows[i : i + ROWS] for i in range(0, len(rows), ROWS))
    idf = np.log((1 + n) / (1 + sum((counts[rows] > 0).sum(0) for rows in blocks(np.arange(n))))).astype(np.float32) + 1
    y = np.array([languages.index(v) for v in labels])
    found, of = [], []
    for k in range(len(languages)):
        own = np.flatnonzero(y == k)
        z = np.empty((len(own), WIDTH), np.float32)
        for i, rows in enumerate(blocks(own)):
            z[i * ROWS : i * ROWS + len(rows)] = vectors(counts[rows], idf)
        pick = [int((z @ z.mean(0)).argmax())]
        while len(pick) < min(clusters, len(z)):  # the next one lies farthest from those before
            pick.append(int((z @ z[pick].T).max(1).argmin()))
        c = z[pick]
        for _ in range(20):
            near = (z @ c.T).argmax(1)
            new = np.array([z[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.abs(new - c).max() < 1e-5:
                break
            c = new
        found.append(c)
        of += [k] * len(c)
    centroids, of = np.vstack(found), np.array(of)
    score, b = np.empty(n, np.float32), np.empty(n, np.int64)
    for rows in blocks(np.arange(n)):
        x = counts[rows]
        score[rows], b[rows] = (vectors(x, idf) @ centroids.T).max(1), buckets(x, 24)
    limits, low = np.zeros(24), 0.0
    for j in range(24):  # longer texts come closer to centroids; a length without a sample takes the shorter one's limit
        low = max(low, SLACK * float(score[b == j].min())) if (b == j).sum() >= 20 else low
        limits[j] = min(low, MOST)
    return Model(languages, idf, centroids.astype(np.float32), of, limits)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on rows with text and lang; which of them is a matter of their doc_id's hash."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], each / r["count"]) for r in sizes], "lang string, share double")
    picked = labelled.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang")  # LANGUAGES rows at most
    picked = picked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    schema = "lang string, places binary, counts binary"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = shape
        for part, data, offsets in byte_slices(batches, most=SLICE, rows=ROWS):
            rows = features(data, offsets)
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([r[a].astype("<u4").tobytes() for r, a in zip(rows, at, strict=True)], pa.binary())], schema=to)

    got = sorted(map(tuple, picked.select("lang", "text").mapInArrow(released(run), schema).collect()))  # bounded by ``sample``
    return fit(Sample([g[1] for g in got], [g[2] for g in got]), [g[0] for g in got])


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and rejected."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, lang_pred string, score double, rejected boolean"
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the sample and WIDTH only
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, m = shape, shipped.value
        for part, data, offsets in byte_slices(batches, most=SLICE, rows=ROWS):
            n = part.num_rows
            letters = np.array([has_letter(t) for t in part.column("text").to_pylist()])
            names, score, rejected = np.array([UND] * n, object), np.zeros(n), ~letters
            if m:
                at, s, r = m.predict(features(data, offsets))
                names = np.where(letters, np.array(m.languages, object)[at], UND)
                score, rejected = np.where(letters, s, 0.0), r | ~letters
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], schema=to)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(released(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns, whatever their names."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for part, data, offsets in byte_slices(batches, most=SLICE, rows=ROWS):
            keep = np.array([has_letter(t) for t in part.column("text").to_pylist()])
            if m:
                keep &= ~m.predict(features(data, offsets))[2]
            yield part.filter(pa.array(keep))

    return map_rows(docs, run)
