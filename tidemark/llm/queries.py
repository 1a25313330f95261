"""Registered queries of this subpackage: thin calls of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, chunk_dedup, hnsw, katz, pair_heap, pfair, pii, pivotal_grams, recompression, secrets, simhash, site_quality, toxic_segments
from tidemark.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_heap.count_tokens(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks", "copies")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pfair.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.selectExpr("doc_id", "source", "_block AS block", "_release AS release_slot", "_deadline AS deadline_slot", "_slot AS slot", "_position AS position", "_in_proportion AS in_proportion")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_segments.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digests(recompression.periodic_runs(table(spark, sf_dir, "documents"), recompression.planted_period))


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_grams.variants(pivotal_grams.vocabulary(table(spark, sf_dir, "documents"), pivotal_grams.deleted_letter))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality, op3_bpe, op4_token_counts, op5_secrets, op6_simhash, op7_exact_dedup, op8_mixing, op9_nearest, op10_toxicity, op11_runs, op12_katz, op13_variants)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
            g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
            FROM t JOIN g USING (body)
        """,
        "op8_mixing": """
            WITH RECURSIVE d AS (SELECT doc_id, source, md5(concat_ws(':', CAST(doc_id AS VARCHAR), '17')) AS h FROM documents),
            numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS num FROM d),
            sizes AS (SELECT source, count(*) AS n, pow(count(*), 0.7) AS w FROM d GROUP BY source),
            parts AS (SELECT source, n, CAST(greatest(1, round(w / sum(w) OVER () * 1000000000)) AS BIGINT) AS part, greatest(8, CAST(ceil(sum(n) OVER () / 32768) AS BIGINT)) AS per FROM sizes),
            src AS (SELECT *, CAST(sum(part) OVER () AS BIGINT) AS whole, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM parts),
            q AS (SELECT list(part ORDER BY i) AS a, list(CAST(ceil(n / per) AS BIGINT) ORDER BY i) AS b, max(whole) AS whole, sum(CAST(ceil(n / per) AS BIGINT)) AS total, min((n // per) * whole // part) AS horizon FROM src),
            run(step, t, done, pick) AS (
              SELECT 0, CAST(0 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM q
              UNION ALL
              SELECT step + 1, u + 1, list_transform(done, lambda x, j: CASE WHEN j = p THEN x + 1 ELSE x END), p FROM (
                SELECT step, u, done, list_min(list_filter(list_transform(range(1, len(a) + 1), lambda j:
                  CASE WHEN done[j] < b[j] AND done[j] * whole // a[j] <= u THEN ((done[j] + 1) * whole + a[j] - 1) // a[j] * 1000000 + j END), lambda x: x IS NOT NULL)) % 1000000 AS p
                FROM (SELECT step, done, a, b, whole, greatest(t, list_min(list_filter(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN done[j] < b[j] THEN done[j] * whole // a[j] END), lambda x: x IS NOT NULL))) AS u
                  FROM run, q WHERE step < total))),
            plan AS (SELECT pick AS i, done[pick] - 1 AS block, t - 1 AS slot FROM run WHERE step > 0),
            blocks AS (SELECT doc_id, n.source, num // per AS block, num % per AS place, i, part, whole, per FROM numbered n JOIN src s ON n.source IS NOT DISTINCT FROM s.source)
            SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(block * whole // part AS BIGINT) AS release_slot, CAST(((block + 1) * whole + part - 1) // part AS BIGINT) AS deadline_slot,
              CAST(slot AS BIGINT) AS slot, CAST(slot * per + place AS BIGINT) AS position, slot < (SELECT horizon FROM q) AS in_proportion
            FROM blocks JOIN plan USING (i, block)
        """,
    }
