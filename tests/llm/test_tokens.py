import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import common, huffman, packing
from kinetrace.llm.common import Folder, Scratch
from kinetrace.llm.tokens import crc32, encoder, vocabulary

TEXTS = ["", None, "it's '''ll d'x _a_ <|endoftext|> x", "İstanbul ΣΑΣ é  x\x85y \x1cz", "don't!'s __x__ 1234 ½ ² ª", "日本語 テスト", "Éà ŉ ĳ Ÿ ſ", "the cat sat on the mat. " * 900, "word", "word"]


def library(text):
    return encoder(vocabulary()).library.encode(text or "", add_special_tokens=False).ids + [1]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).withColumn("start", F.lit("clash"))


def test_word_wise_encoding_equals_the_library():
    r = random.Random(0)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("abé 'sßÜ.!_1\n") for _ in range(60)) for _ in range(200)]
    ids, bounds = encoder(vocabulary()).encode_ended(texts, 1)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library(t)


@pytest.mark.parametrize(("n", "k"), [(1, 1), (2, 2), (257, 3), (5000, 400), (20000, 9000)])
def test_code_round_trip(n, k):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n) - 1, k - 1).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    assert lengths.max() <= huffman.LIMIT
    data = huffman.write_segment(np.arange(1), np.array([n]), ids, lengths, huffman.canonical(lengths))
    assert (huffman.read_segment(data, huffman.Decoder(lengths))[2] == ids).all()


def test_length_limit_binds():
    counts = np.array([1 << k for k in range(30)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() == 8
    assert sum(2.0 ** -float(x) for x in lengths) <= 1


def test_archive(spark):
    scratch = Scratch(spark, "t")
    huffman.write_archive(scratch, frame(spark, TEXTS))
    rows = huffman.read_archive(spark, scratch).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, TEXTS, strict=True):
        want = library(t)
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (start, len(want), want, crc32(np.array(want)))
        start += len(want)


def test_empty_archive(spark):
    scratch = Scratch(spark, "t")
    huffman.write_archive(scratch, frame(spark, TEXTS).limit(0))
    assert huffman.read_archive(spark, scratch).count() == 0


def test_archive_of_odd_rows_at_a_path(spark, tmp_path):
    rows = [(3, "b a"), (None, "x"), (3, "a"), (None, None), (1, "c"), (3, "a")]
    huffman.write_archive(Folder(spark, f"file://{tmp_path}/ids"), spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"kind": F.lit("k"), "a.b": F.lit(1)}))
    got = huffman.read_archive(spark, Folder(spark, f"file://{tmp_path}/ids")).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3, 3]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(d), library(t)) for d, t in rows)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_codes_of_large_vocabularies():
    lengths = huffman.code_lengths(np.ones((1 << 5) + 1, np.int64), 5)
    assert lengths.max() == 6


def test_packing(spark):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["alpha", "beta", "of", "x"]) for _ in range(r.randint(1, 700))) for _ in range(300)]
    docs = frame(spark, texts)
    out = packing.packed_documents(docs, capacity=512)
    rows = out.collect()
    seen, places = {}, {}
    for x in rows:
        seen.setdefault(x["doc_id"], []).append(x)
        places.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert sorted(seen) == list(range(len(texts)))
    for d, got in seen.items():
        ids, at = library(texts[d]), 0
        for x in sorted(got, key=lambda x: x["piece"]):
            part = ids[x["start"] : x["start"] + x["length"]]
            assert x["start"] == at
            assert x["ids_crc32"] == crc32(np.array(part))
            at += x["length"]
        assert at == len(ids)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(x["length"] for x in rows)
    lower = max(-(-total // 512), sum(x["length"] > 256 for x in rows))
    assert len(places) <= lower * 1.02 + 1
    whole = {x["sequence_id"]: x["ids"] for x in packing.sequences(docs, out).collect()}
    assert sum(map(len, whole.values())) == total


def items_of(spark, n, length, parts=8):
    zero = F.lit(0).cast("bigint")
    return spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), zero.alias("start"), length.cast("bigint").alias("length"), zero.alias("ids_crc32"))


def sound(out, capacity):
    """Sequences: from 0 without gaps, within the capacity. Their number."""
    cut = "row_number() over (partition by sequence_id order by offset)"
    before = "coalesce(sum(length) over (partition by sequence_id order by offset rows between unbounded preceding and 1 preceding), 0)"
    assert out.selectExpr("*", f"{before} as at", f"{cut} as k").where(f"at <> offset or at + length > {capacity}").count() == 0
    return out.select("sequence_id").distinct().count()


@pytest.mark.parametrize("steps", [40, 1 << 16])
def test_steps_of_many_pieces(spark, steps):
    items = items_of(spark, 50_000, F.col("id") * F.col("id") % 97 + 1)
    out = packing.pack(Scratch(spark, "t"), items, 100, steps=steps).cache()
    total = out.agg(F.sum("length")).first()[0]
    assert out.select("doc_id").distinct().count() == out.count() == 50_000
    assert sound(out, 100) <= total / 100 * (1.02 if steps > 40 else 1.05) + 2


def test_pieces_beyond_half_a_sequence(spark):
    out = packing.pack(Scratch(spark, "t"), items_of(spark, 200_000, F.lit(2100)))
    assert sound(out, 4096) == out.count() == 200_000


def test_hot_length_and_full_pieces(spark):
    length = F.when(F.col("id") % 3 == 0, 4096).when(F.col("id") % 3 == 1, 12).otherwise(F.col("id") % 4095 + 1)
    out = packing.pack(Scratch(spark, "t"), items_of(spark, 30_000, length)).cache()
    total = out.agg(F.sum("length")).first()[0]
    assert out.count() == 30_000
    assert sound(out, 4096) <= total / 4096 * 1.005 + 2


def test_plan_of_a_huge_corpus():
    counts = np.bincount(np.minimum(np.random.default_rng(1).lognormal(6.5, 1.2, 100_000).astype(int) + 1, 4096), minlength=4097) * 100_003
    got = packing.plan(counts)
    assert len(got.key) < 500_000
    assert got.copies.sum() == counts[:-1].sum()
    total = (counts[:-1] * np.arange(4096)).sum()
    assert got.n_bins <= total / 4096 * 1.001 + 1


def test_sum_of_squares_by_brute_force():
    """Single steps against the rule itself, tried over all open bins."""
    r = random.Random(4)
    for _ in range(30):
        lengths = sorted((r.randint(1, 19) for _ in range(60)), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        gaps = []
        for s in lengths:
            squares = lambda g: sum(x * x for x in np.bincount(g, minlength=21)[1:-1].tolist())
            fits = [(squares([h - s if k == j else h for k, h in enumerate(gaps)]), g, j) for j, g in enumerate(gaps) if g >= s]
            if fits:
                gaps[min(fits)[2]] -= s
            else:
                gaps.append(20 - s)
        got = packing.plan(counts)
        filled = np.zeros(got.n_bins, int)
        np.add.at(filled, got.bin, got.key >> 48)
        assert sorted(20 - filled) == sorted(gaps)


def test_workers_release_memory_at_the_end_of_a_task(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    assert list(common.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]
    half = common.released(lambda batches: batches)(x for x in (1, 2))
    assert next(half) == 1 and done == [1]
    half.close()
    assert done == [1, 1]


def one_by_one(counts):
    """Open bins by gap after best fit of single pieces in order of falling length."""
    capacity = len(counts) - 1
    gaps = [0] * (capacity + 1)
    for s in range(capacity - 1, 0, -1):
        for _ in range(int(counts[s])):
            g = next((g for g in range(s, capacity) if gaps[g]), capacity)
            gaps[g] -= g < capacity
            gaps[g - s] += 1
    return gaps


def test_best_fit_by_brute_force():
    r = np.random.default_rng(5)
    for n, top in ((0, 20), (1, 20), (60, 20), (500, 5), (3000, 20)):
        counts = np.bincount(r.integers(1, top, n), minlength=21)
        got = packing.best_fit(counts)
        length = np.repeat(np.arange(20), counts[:20])
        number = np.concatenate([np.arange(c) for c in counts[:20]]).astype(np.int64)
        at, offset = got.look_up(length, number) if n else (length, number)
        filled = np.bincount(at, weights=length, minlength=got.n_bins).astype(int)
        assert np.bincount(20 - filled, minlength=21).tolist() == one_by_one(counts)
        order = np.lexsort((offset, at))
        ends = (offset + length)[order]
        assert (np.where(np.diff(at[order], prepend=-1) > 0, 0, np.roll(ends, 1)) == offset[order]).all()
        assert got.copies.sum() == n


def test_places_do_not_depend_on_the_number_of_pieces(spark):
    n = packing.ITEMS + 5000
    out = packing.pack(Scratch(spark, "t"), items_of(spark, n, F.col("id") * F.col("id") % 29 + 1), 31)
    counts = np.bincount([i * i % 29 + 1 for i in range(n)], minlength=32)
    want = one_by_one(counts)
    got = {r["gap"]: r["count"] for r in out.groupBy("sequence_id").agg((31 - F.sum("length")).alias("gap")).groupBy("gap").count().collect()}
    assert got == {g: k for g, k in enumerate(want) if k}


def test_best_fit_of_a_huge_corpus():
    counts = np.bincount(np.minimum(np.random.default_rng(1).lognormal(6.5, 1.2, 100_000).astype(int) + 1, 4096), minlength=4097) * 100_003
    got = packing.best_fit(counts)
    assert len(got.key) < 100_000
    assert got.copies.sum() == counts[:-1].sum()
    assert got.n_bins <= (counts[:-1] * np.arange(4096)).sum() / 4096 * 1.0001 + 1


def test_packing_of_no_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (2, None)], "doc_id bigint, text string").withColumns({"task": F.lit("x"), "nth": F.lit(1), "length": F.lit("z"), "a.b": F.lit(0)})
    out = packing.packed_documents(docs)
    assert (out.count(), sound(out, 4096)) == (5, 1)
    assert packing.packed_documents(docs.limit(0)).count() == 0
