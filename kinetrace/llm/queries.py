"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hnsw, huffman, langid, minhash, packing, secrets, suffixes, urls, warc
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op4_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    huffman.write_archive(scratch, table(spark, sf_dir, "documents"))
    return huffman.read_archive(spark, scratch, with_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_archive(scratch, table(spark, sf_dir, "pages"))
    return warc.archive_report(scratch)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "item_shingles")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_embedding_dedup, op3_best_fit_packing, op4_token_archive, op5_warc, op6_minhash, op7_suffix_array_dedup, op8_url_filters, op9_decontamination, op10_secret_scans)}


OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS d FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS owner FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM w
"""


OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.k, 0) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""

OP9 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM bs GROUP BY r)
SELECT ds.doc_id, bs.item_id, count(*) AS shared, n.n AS item_shingles
FROM ds JOIN bs ON ds.s = bs.s JOIN n ON n.r = bs.r
GROUP BY ds.doc_id, ds.r, bs.item_id, bs.r, n.n HAVING 10 * count(*) >= 8 * n.n
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2, "op5_warc": OP5, "op9_decontamination": OP9}
