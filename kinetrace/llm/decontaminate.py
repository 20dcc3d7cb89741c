"""Benchmark decontamination: size-partitioned minwise containment search, in DataFrame functions alone.

An item is the set of its five-word shingles (of lower-case words of letters and digits; with fewer words, the whole sequence). A
document is contaminated by an item if it holds at least ``SHARE`` of the item's set. Items are partitioned by the size of their
sets, by powers of two. A partition with sets below u has its own sketch length, u * (1 - SHARE) + ``HITS``: the shingles with the
smallest hashes. A document that holds SHARE of an item lacks at most (1 - SHARE) of it, so it must hit the sketch ``HITS`` times or
more (or hold SHARE of the whole set, where the sketch is all of it); so the search loses nothing. Candidates are then held
against full sets of shingle texts.

Documents of any length are searched whole: each distinct shingle's hash is looked up in the sketches. Spark broadcasts the
sketches, and later the candidates, where their size at run time is below its threshold, else it shuffles by hash.

Items of one to four words match only documents that consist of just these words; inside longer documents they aren't searched, as in
the SQL of this operator.

Null or wordless texts, of documents or items, match nothing. Repeated items are items of their own; equal rows of documents give
one row per item. Null doc_ids are carried along. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused

WIDTH, SHARE, HITS = 5, 0.8, 4


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hashes(w: str, width: int = WIDTH) -> Column:
    """Hashes of the distinct shingles of an array of words."""
    c = F.col(w)
    many = F.transform(F.sequence(F.lit(1), F.size(c) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(c, i + k) for k in range(width)]))
    return F.when(F.size(c) >= width, F.array_distinct(many)).when(F.size(c) > 0, F.array(F.xxhash64(F.concat_ws(" ", c))))


def shingles(w: str, width: int = WIDTH) -> Column:
    """The distinct shingles themselves."""
    c = F.col(w)
    many = F.transform(F.sequence(F.lit(1), F.size(c) - (width - 1)), lambda i: F.concat_ws(" ", F.slice(c, i, width)))
    return F.when(F.size(c) >= width, F.array_distinct(many)).when(F.size(c) > 0, F.array(F.concat_ws(" ", c)))


def sketches(items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_key, need, h): for each item its sketch, and how many hits a contaminated document has at least."""
    sets = items.select("item_key", hashes("w").alias("hs")).where("hs is not null").withColumn("n", F.size("hs"))
    upper = F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1) - 1  # of the item's partition by size
    length = F.floor(upper * F.lit(1 - share) + 1e-9) + HITS
    least = F.ceil(F.col("n") * F.lit(share) - 1e-9)
    cut = sets.withColumn("length", F.least(length, F.col("n")).cast("int"))
    need = F.when(F.col("length") == F.col("n"), least).otherwise(F.lit(HITS)).cast("bigint")
    return cut.select("item_key", need.alias("need"), F.explode(F.slice(F.array_sort("hs"), F.lit(1), F.col("length"))).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document and item: doc_id, item_id, shared, item_shingles, containment; doc_key names the document's row."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select("item_id", "text").select("item_id", F.xxhash64("item_id", "text").alias("item_key"), words("text").alias("w"))
    items = scratch.write(items.where("size(w) > 0"), "items")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), words("text").alias("w"))
    probes = keyed.select("doc_key", F.explode(hashes("w")).alias("h"))
    marks = scratch.write(sketches(items.dropDuplicates(["item_key"]), share), "sketches")
    hits = probes.join(marks, "h").groupBy("doc_key", "item_key", "need").agg(F.count(F.lit(1)).alias("hits"))
    found = scratch.write(hits.where("hits >= need").select("doc_key", "item_key"), "candidates")
    again = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key")).join(found.select("doc_key").distinct(), "doc_key", "left_semi")
    # Shingle texts for the documents found, once each; then with each of their items.
    texts = again.dropDuplicates(["doc_id", "doc_key"]).select("doc_id", "doc_key", words("text").alias("w")).select("doc_id", "doc_key", shingles("w").alias("doc_set"))
    sets = items.select("item_id", "item_key", shingles("w").alias("item_set"))
    both = texts.join(found, "doc_key").join(sets, "item_key")
    both = both.select("doc_key", "doc_id", "item_id", F.size(F.array_intersect("doc_set", "item_set")).cast("bigint").alias("shared"), F.size("item_set").cast("bigint").alias("item_shingles"))
    exact = both.where(F.col("shared") >= F.ceil(F.col("item_shingles") * F.lit(share) - 1e-9))
    return exact.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def without(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows of ``docs`` that no item contaminates, with all their columns."""
    name = unused("bad_doc_key", docs.columns)
    # Written first, so that its size is known when the join is planned: a short list doesn't ask for a shuffle of all texts.
    bad = Scratch(docs.sparkSession, "decontaminated").write(contaminated(docs, benchmark, share).select(F.col("doc_key").alias(name)).distinct(), "bad")
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col(name), "left_anti")
