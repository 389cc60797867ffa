"""The queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parasol.llm import ann, decontamination, extraction, langid, lm, mixing, quality, sharding, simhash, substrings
from parasol.llm.common import batched


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched(spark)
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.shard(_table(spark, sf_dir, "documents"), keep_text=False)
    return docs.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched(spark)
    return simhash.report(_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched(spark)
    return langid.report(_table(spark, sf_dir, "documents"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched(spark)
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched(spark)
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched(spark)
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched(spark)
    return lm.score(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_substrings": op3_substrings,
    "op4_sharding": op4_sharding,
    "op5_ann": op5_ann,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_lm": op8_lm,
    "op9_langid": op9_langid,
    "op10_extraction": op10_extraction,
}

OP2_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM pattern),
win AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM doc, lengths WHERE len(w) >= n)),
occ AS (SELECT win.r, win.k, win.n, pattern.item_id FROM win JOIN pattern USING (n, p)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit
        FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS j FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

ORACLES: dict[str, str] = {"op2_decontamination": OP2_SQL}
