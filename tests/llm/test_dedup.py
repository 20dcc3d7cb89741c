import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import hnsw, minhash, suffixes
from kinetrace.llm.common import Scratch, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_groups(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    where, root, shared = defaultdict(list), {d: d for d in sets}, defaultdict(int)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    for docs in where.values():
        for a, b in itertools.combinations(sorted(docs), 2):
            shared[a, b] += 1

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(n, seed=5):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randint(20, 120))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  B"), (n + 4, "one"), (n + 5, "z" * 200_000)]


@pytest.mark.parametrize(("leaf", "levels"), [(512, 3), (16, 1)])
def test_minhash(spark, leaf, levels):
    rows = near_copies(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumns({"cls": F.lit(1), "sig": F.lit("x")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 3, 85, leaf=leaf, levels=levels).collect()}
    assert got == brute_groups(rows, 3, 85)


def test_minhash_families_beyond_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCKS", 1)
    rows = near_copies(300, seed=9)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 3, 85, leaf=16).collect()}
    assert got == brute_groups(rows, 3, 85)


def sharing(n, shared, alike, seed=3):
    """n pairs of near copies, that alone are links, of texts that all begin by one passage. Shingles of width 1; about ``alike`` in a pair."""
    r = random.Random(seed)
    passage, rows = [f"s{i}" for i in range(shared)], []
    for i in range(n):
        own = [f"o{i}.{k}" for k in range(100 - shared)]
        change = round(100 * (1 - alike) / (1 + alike))
        copy = own[change:] + [f"c{i}.{k}" for k in range(change)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + copy))]
    r.shuffle(rows)
    return rows


def parted(spark, rows, percent, **sizes):
    """How many of the pairs of :func:`sharing` aren't linked, or with others."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 1, percent, **sizes).collect()}
    return sum((got[d], got[d + 1]) != (d, d) for d in range(0, len(rows), 2))


def test_minhash_joined_classes_stay(spark):
    """At 82 shared words of 100 (similarity 0.69) about half of all classes are candidates of a node's chosen two, and half aren't."""
    assert parted(spark, sharing(400, 82, 0.91), 90, leaf=16, levels=4) == 0


def test_minhash_large_nodes_keep_recall(spark):
    """With few trees: a large node that branches by one coordinate loses several of these pairs."""
    assert parted(spark, sharing(400, 82, 0.91), 90, leaf=16, trees=3, levels=6) == 0


def test_minhash_giant_families_lose_no_link(spark, monkeypatch):
    """Two trees find the family; all links within it must be found whatever its size."""
    rows, lost = sharing(400, 75, 0.81), []
    for blocks in (100, 1):
        monkeypatch.setattr(minhash, "BLOCKS", blocks)
        lost.append(parted(spark, rows, 80, leaf=16, trees=2))
    assert lost[0] == lost[1]


def test_minhash_words_of_like_letters(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2^64 under every odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "x " + word), (4, word.upper())]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_words_in_windows(monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("abAé \t\n") for _ in range(r.randint(0, 90))) for _ in range(60)] + ["", "z" * 500, " " * 300, "q" * 70 + " " + "q" * 71]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    whole = np.frombuffer(b"".join(data), np.uint8)
    at, hashes = minhash.words(whole, offsets)
    monkeypatch.setattr(minhash, "WINDOW", 37)
    at2, hashes2 = minhash.words(whole, offsets)
    assert (at == at2).all()
    assert (hashes == hashes2).all()
    names, k = {}, 0
    for i, t in enumerate(texts):
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", data[i]):
            assert at[k] == offsets[i] + m.start()
            assert names.setdefault(m[0].lower(), hashes[k]) == hashes[k]
            k += 1
    assert k == len(at)
    assert len(set(names.values())) == len(names)


def test_minhash_columns_of_any_name(spark):
    names = ["a.b", "cls", "twin", "sig", "text_hash", "node", "n_shingles", "component", "group_id", "label"]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g")], "doc_id bigint, text string").withColumns({n: F.lit("x") for n in names})
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_minhash_shared_names_are_renamed(spark):
    rows = spark.createDataFrame([(5, 1), (5, 2), (5, 1), (None, None)], "cls bigint, twin bigint")
    got = [r["cls"] for r in minhash.renamed(rows, 1).collect()]
    assert got[0] == got[2] != got[1]
    assert got[3] is None


def test_minhash_boilerplate(spark):
    """Texts that share 70 words of 100, with leaves of the size that the query uses."""
    assert parted(spark, sharing(1200, 70, 0.86), 80) == 0


def test_minhash_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (1, "other words that are not alike at all")]
    got = sorted(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=str)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]} == {(1, 1, True), (2, 1, False)}
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 300)]
    got = {r["id"]: r["component"] for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint"), "c").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def passages(seed=1):
    r = random.Random(seed)
    w = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    shared, rows = [" ".join(r.choice(w) for _ in range(40)) for _ in range(4)], []
    for i in range(150):
        t = " ".join(r.choice(w) for _ in range(r.randint(0, 120)))
        for _ in range(r.randint(0, 3)):
            k, a = r.randint(0, len(t)), r.randint(0, 60)
            t = t[:k] + r.choice(shared)[a : a + r.randint(80, 250)] + t[k:]
        rows.append((i, t))
    rows += [(150, "ab" * 500), (151, "a" * 1000), (152, None), (153, ""), (154, rows[5][1]), (155, "x" * 100), (156, "x" * 101)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("many", [1000, 3])
def test_suffixes(spark, many):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("row", F.lit("clash"))
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.deduplicated(docs, many=many).collect()}
    assert got == brute_repeats(rows)


def test_suffixes_odd_rows(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(150))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (2, "y")], "doc_id bigint, text string")
    rows = sorted(tuple(r)[:3] for r in suffixes.deduplicated(docs).collect() if r["doc_id"] is not None)
    assert rows == [(2, 1, 0), (3, 150, 150), (3, 150, 150)]
    assert suffixes.deduplicated(docs.limit(0)).count() == 0


def test_index_levels_stay_logarithmic():
    r, index, seen = random.Random(2), suffixes.Index(), set()
    for _ in range(40):
        batch = [f"{r.randrange(2000):05d}" for _ in range(50)]
        got = index.add(np.array(batch, "S5"))
        for s, again in zip(batch, got, strict=True):
            assert again == (s in seen)
            seen.add(s)
    assert len(index.levels) <= 8


def brute_vectors(rows, cosine=0.95):
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = defaultdict(set)
    for a, b in itertools.combinations(good, 2):
        if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= cosine:
            links[a].add(b)
            links[b].add(a)
    out = []
    for i, (vid, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((vid, len(links[i]), low, vid == low))
    return sorted(out)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 16))
    rows = [(i, (centre[rng.integers(30)] + rng.normal(0, rng.choice([0.02, 0.15, 0.25]), 16)).tolist()) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [1.0, 2.0]), (405, [2.0, 4.0]), (406, rows[0][1]), (407, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"hub": F.lit(1), "label": F.lit(2)})
    got = sorted(tuple(r) for r in hnsw.near_duplicates(table, least_shards=3).collect())
    assert got == brute_vectors(rows)
    assert hnsw.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_of_any_size(spark):
    rows = [(1, [1e200, 1.0]), (2, [2e200, 1.0]), (3, [1e-200, 0.0]), (4, [1e-200, 1e-203]), (5, [1.0, 0.0]), (6, [0.0, -1e308]), (7, [0.0, -5e-324])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), least_shards=2).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (1, 6), 7: (1, 6)}


def test_equal_embeddings_are_a_row_of_the_index(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    some = [(centre[i % 12] + rng.normal(0, 0.1 + 0.02 * (i % 8), 16)).tolist() for i in range(90)]
    rows = [(i, some[i % 90 if i % 2 else i % 4]) for i in range(600)] + [(900, [2 * x for x in some[0]]), (901, [0.0] * 16), (None, some[1])]
    written = {}

    def write(self, df, name, by=None, old=hnsw.Scratch.write):
        written[name] = old(self, df, name, by)
        return written[name]

    monkeypatch.setattr(hnsw.Scratch, "write", write)
    got = sorted(tuple(r) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), least_shards=3).where("vec_id is not null").collect())
    assert got == brute_vectors([r for r in rows if r[0] is not None])
    good = len({tuple(v) for _, v in rows if any(v)} - {tuple(rows[600][1])})
    assert written["index"].where("kind = 'member'").count() == good
    # Pairs that can't be linked have gone where they were found.
    assert 0 < written["pairs"].count() == written["judged"].count()


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, leader = hnsw.build(x, rng.random(len(x)))
    assert len(graph.x) == len(set(leader.tolist()))
    q = x + rng.normal(0, 0.02, x.shape)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    got = graph.within(q, np.full(len(q), 0.95), hnsw.audited_beam(graph, 0.9, rng))
    want = (q @ graph.x.T) >= 0.95
    assert sum(int(want[i][g].sum()) for i, g in enumerate(got)) >= 0.99 * want.sum()
