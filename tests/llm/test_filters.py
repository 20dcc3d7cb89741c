import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import decontaminate, langid, urls, warc
from kinetrace.llm.common import Folder, Scratch, byte_slices

EN, DE = "the quick brown fox jumps over the lazy dog and then the cat", "der schnelle braune Fuchs springt über den faulen Hund und die Katze"


def labelled(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice((EN if i % 2 else DE).split()) for _ in range(r.randint(1, 30))), "en" if i % 2 else "de") for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language(spark):
    model = langid.train(labelled(spark).where(~langid.held_out()))
    rows = [(0, "the lazy dog and the fox"), (1, "und der Hund über die Katze"), (2, None), (3, "123 !?"), (4, ""), (5, "the cat " * 30_000), (6, "日本語"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang_pred": F.lit("zz"), "score": F.lit(9)})
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert {got[6]["lang_pred"], got[7]["lang_pred"]} <= {"en", "de"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["rejected"] for i in (0, 1, 2, 3)] == [False, False, True, True]
    assert sorted(r["doc_id"] for r in langid.kept(docs, model).collect()) == [i for i in range(8) if not got[i]["rejected"]]


def test_language_held_out_accuracy(spark):
    docs = labelled(spark)
    out = langid.identify(docs, langid.train(docs.where(~langid.held_out())), ("doc_id", "lang")).where(langid.held_out())
    assert out.where("lang = lang_pred and not rejected").count() == out.count() > 20


def brute_grams(text):
    """Counts of hashed n-grams by their definition, one by one."""
    b, out = text.encode(), []
    for i, c in enumerate(b):
        if c < 128:
            out.append(c | 32 if chr(c).isalpha() else 32)
        else:
            out.append(c + 32 if i and b[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97 else c)
    y = bytes([32, *out, 32])
    y = re.sub(rb"\x20+", b" ", y)
    counts = np.zeros(langid.WIDTH, int)
    for i in range(len(y) - 1):
        counts[((y[i] << 8 | y[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 22] += 1
        if i < len(y) - 2:
            counts[1024 + (((y[i] << 16 | y[i + 1] << 8 | y[i + 2]) * 0x85EBCA6B & 0xFFFFFFFF) >> 16) % (langid.WIDTH - 1024)] += 1
    return counts


def test_language_features_and_centroids_by_brute_force(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abÉß ,.Öx×") for _ in range(r.randint(0, 60))) for _ in range(40)] + ["", "  ", "q"]
    want = np.array([brute_grams(t) for t in texts])
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    assert (langid.features(np.frombuffer(b"".join(data), np.uint8), offsets) == want).all()
    monkeypatch.setattr(langid, "WINDOW", 7)
    for d, w in zip(data, want, strict=True):
        assert (langid.features(np.frombuffer(d, np.uint8), np.array([0, len(d)])) == w).all()
    model = langid.fit(want, [f"l{i % 3}" for i in range(len(texts))], clusters=2)
    at, score, _ = model.predict(want)
    for i, c in enumerate(want):
        x = np.log1p(c) * model.idf
        best = max((float(x @ m) / (np.linalg.norm(x) or 1), -k) for k, m in enumerate(model.centroids.astype(float)))
        assert score[i] == pytest.approx(min(max(best[0], 0), 1), abs=1e-5)
        own = max(float(x @ m) for m, k in zip(model.centroids, model.of, strict=True) if k == at[i])
        assert own == pytest.approx(best[0] * (np.linalg.norm(x) or 1), abs=1e-3)


def test_few_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    more = labelled(spark).unionByName(spark.createDataFrame([(900, "zz yy", "zz")], "doc_id bigint, text string, lang string"))
    assert langid.train(more).languages == ("de", "en")


def test_language_without_labels(spark):
    docs = labelled(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(docs) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), None).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for _, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best)):
            best = h + p
    return host, path, best


URLS = ["http://A.example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/1", "http://com/de/1", "http://xcom/de/1", "ftp://a.net", "nourl", None, "", "http://", "http://h?q=/de/", "http://good.net/ok", "http://bad.net/spam", "http://u://v/w", "http://É.org/ß/"]


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    verdicts = {h + p: v for v, h, p in urls.RULES}
    for i, u in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute_url(u)
        assert got[i]["verdict"] == verdicts[got[i]["rule"]] if got[i]["rule"] else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_segmentation_and_bayes():
    words = urls.fit_words({"redcar": 1, "redbus": 2, "bluecar": 1, "bluebus": 1, "red": 1, "car": 1, "bus": 1, "blue": 1, "example": 40})
    assert words.split("bluecar") == ["blue", "car"]
    assert words.split("example") == ["example"]
    assert words.split("") == []
    rows = [("redcar.x", "/a", "block")] * 3 + [("bluebus.x", "/b", "allow")] * 3
    model = urls.fit_bayes(rows, words)
    assert model.score("redbus.x", "/a") > 0 > model.score("bluecar.x", "/b")
    weight = math.log((3 + 1) / (12 + 7)) - math.log((0 + 1) / (12 + 7))
    assert model.weights["red"] == pytest.approx(weight)


def test_viterbi_by_brute_force():
    r = random.Random(5)
    for _ in range(40):
        parts = {"".join(r.choice("ab") for _ in range(r.randint(1, 3))): r.uniform(0.5, 6) for _ in range(5)}
        words, name = urls.Words(parts, 7.0), "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        cost = lambda split: sum(parts.get(w, 7.0 * len(w)) for w in split)
        splits = []
        for cuts in itertools.product([False, True], repeat=len(name) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
            splits.append([name[a:b] for a, b in itertools.pairwise(at)])
        assert "".join(words.split(name)) == name
        assert cost(words.split(name)) == pytest.approx(min(map(cost, splits)))


def test_verdicts_by_brute_force(spark):
    """Multinomial naive Bayes written out, over the segmented tokens."""
    r = random.Random(7)
    rows = [(f"http://{r.choice(['red', 'blue'])}{r.choice(['car', 'bus'])}.{t}/{p}/{r.randint(0, 9)}", i) for i, (t, p) in enumerate(r.choices([("org", "a"), ("com", "de"), ("com", "fr"), ("net", "de"), ("net", "a"), ("io", "fr")], k=300))]
    rows += rows[:3] + [(None, 900)]
    pages = spark.createDataFrame(rows, "url string, page_id bigint")
    got = urls.judge(pages).collect()
    split = {r["host"]: r["words"].split() for r in got}
    tokens = lambda r: split[r["host"]] + ["/" + t for t in re.findall(r"[^\W_]+", r["path"].lower())]
    labels, counts = Counter(), {"allow": Counter(), "block": Counter()}
    for x in got:
        if x["rule"]:
            labels[x["verdict"]] += 1
            counts[x["verdict"]].update(tokens(x))
    seen = set(counts["allow"]) | set(counts["block"])
    for x in got:
        score = math.log((labels["block"] + 1) / (labels["allow"] + 1))
        for t in tokens(x):
            if t in seen:
                score += math.log((counts["block"][t] + 1) / (sum(counts["block"].values()) + len(seen))) - math.log((counts["allow"][t] + 1) / (sum(counts["allow"].values()) + len(seen)))
        assert x["score"] == pytest.approx(score)
        assert x["rule"] or x["verdict"] == ("block" if score > 0 else "allow")


def test_frequent_words_are_bounded(spark):
    words = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(200)], "word string, count bigint")
    assert len(urls._frequent(words, 500)) == 200
    few = urls._frequent(words, 50)
    assert 30 < len(few) <= 50
    assert min(few.values()) > max(1000 // (i + 1) for i in range(200) if f"w{i}" not in few)


def test_words_of_all_labels_are_learned(spark):
    labels = {f"{a}{b}": 1 for a in ("red", "blue", "internationalization") for b in ("car", "bus", "boat")} | {"com": 9, "red": 1, "car": 1}
    table = spark.createDataFrame(list(labels.items()), "label string, count bigint")
    assert urls.learn_words(table).costs == pytest.approx(urls.fit_words(labels).costs)
    assert "internationalization" in urls.fit_words(labels).split("internationalizationcar")
    assert urls.learn_words(table.limit(0)).costs == {}
    # More labels than the sample of 20,000 of old: each part is in a few of them only.
    many = spark.range(30_000).select(F.format_string("http://q%05dz.com/de/1", "id").alias("url"), F.col("id").alias("page_id"))
    words = urls.train(urls.parsed(many)).words
    assert words.split("com") == ["com"]
    assert words.costs["com"] == min(words.costs.values())


PAGES = [(1, "http://a", "x" * 999), (2, "http://b", "x" * 999), (3, "u\r\nv", "é" * 500), (4, None, "é" * 500), (5, "http://c", None), (6, "", ""), (7, "http://d", "é" * 500), (8, "http://e", "y" * 1000), (9, "k" * 5000, "z" * 300_000)]


def test_warc(spark):
    scratch = Scratch(spark, "t")
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({"key": F.lit("a"), "payload": F.lit(3)})
    warc.write_archive(scratch, pages)
    got = {r["page_id"]: tuple(r)[3:] for r in warc.archive_report(scratch).collect()}
    assert {k: v for k, v in got.items() if v[0] == "revisit"} == {3: ("revisit", 7), 4: ("revisit", 7)}
    assert len(got) == len(PAGES)
    assert spark.read.parquet(scratch.path("payloads")).count() == 5
    records = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(scratch).collect()}
    assert records[7].endswith(b"\r\n\r\n" + ("é" * 500).encode() + b"\r\n\r\n")
    assert b"Content-Length: 1000\r\n" in records[7]
    assert records[3].count(b"\r\n\r\n") == 2
    assert b"WARC-Refers-To: <urn:page:7>" in records[3]
    empty = Scratch(spark, "t")
    warc.write_archive(empty, pages.limit(0))
    assert warc.archive_report(empty).count() == 0


def test_warc_at_a_path_and_odd_rows(spark, tmp_path):
    rows = [(1, "http://a", "q" * 2000), (1, "http://a", "q" * 2000), (None, "http://b", "q" * 2000), (None, None, "r" * 2000), (2, "http://c", "q" * 2000)]
    folder = Folder(spark, f"file://{tmp_path}/archive")
    warc.write_archive(folder, spark.createDataFrame(rows, "page_id bigint, url string, html string"), date="2024-05-01T00:00:00Z")
    later = Folder(spark, f"file://{tmp_path}/archive")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archive_report(later).collect())
    assert got == [("1", "revisit", 2), ("1", "revisit", 2), ("2", "response", None), ("None", "response", None), ("None", "revisit", 2)]
    for r in warc.reconstruct(later).collect():
        assert b"WARC-Date: 2024-05-01T00:00:00Z\r\n" in bytes(r["record"])
        assert b"Content-Type: " in bytes(r["record"])


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_decontamination(spark):
    base = [f"w{i}" for i in range(200)]
    items = [(0, " ".join(base[:30])), (1, " ".join(base[50:60])), (2, "short one"), (3, None), (4, "!!"), (5, " ".join(base[:30]))]
    damaged = base[:30]
    damaged[29] = "zzz"
    worse = list(base[:30])
    worse[15] = worse[5] = "zzz"
    docs = [(0, "a b c " + " ".join(base[:30]).upper() + " d"), (1, " ".join(damaged)), (2, " ".join(worse)), (3, "x, ".join(base[50:60])), (4, "Short... ONE"), (5, None), (6, ""), (7, " ".join(base) * 300), (0, "a b c " + " ".join(base[:30]).upper() + " d"), (8, "clean")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["shared"]) for r in decontaminate.contaminated(d, b).collect()}
    want = set()
    for i, t in docs:
        for k, u in items:
            both = shingle_set(t) & shingle_set(u)
            if shingle_set(u) and 10 * len(both) >= 8 * len(shingle_set(u)):
                want.add((i, k, len(both)))
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.without(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _, _ in want}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_columns_of_any_name(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "clean text")], "doc_id bigint, text string").withColumns({n: F.lit(0) for n in ("bad_doc_key", "doc_key", "a.b", "h", "w", "item_key")})
    left = decontaminate.without(docs, items)
    assert left.columns == docs.columns
    assert [r["doc_id"] for r in left.collect()] == [2]


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["", None, "a" * 50, *["b"] * 20, "c" * 30]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for most, rows in ((10, 3), (1000, 7), (1000, 1), (1, 100)):
        got, data = [], b""
        for part, values, offsets in byte_slices(iter([batch, batch.slice(0, 0)]), most=most, rows=rows):
            assert 0 < part.num_rows <= rows and len(offsets) == part.num_rows + 1
            assert part.num_rows == 1 or len(values) <= most
            got += part.column("text").to_pylist()
            data += values.tobytes()
        assert got == texts and data == "".join(t or "" for t in texts).encode()
