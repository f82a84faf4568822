"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chaining, grace, mil, mixing, packing, probminhash, token_output, urls, warc
from .shared import documents

#: The public vocabulary that operators 1 and 9 encode with.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_ids(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path())


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op3_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_grace_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.exact_groups(documents(spark, sf_dir, "doc_id", "text"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized(documents(spark, sf_dir, "doc_id", "source", "text"))
    return mixing.mix_plan(sized, size="size").selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op8_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(documents(spark, sf_dir, "doc_id", "text"))


def op9_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path())


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_warc_segments, op3_additive_ann, op4_attention_mil, op5_url_ngrams, op6_grace_exact, op7_mix_sources, op8_chained_passages, op9_pack_tiers, op10_probminhash)}

#: White space of the contracts, as RE2 writes it.
_BLANKS = r"[\x20\x09-\x0D]+"

OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS rep FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN rep IS NULL OR rep IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rep IS DISTINCT FROM page_id THEN rep END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM r
"""

OP6_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS n, t
      FROM t WINDOW w AS (PARTITION BY t))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS own
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * max(own) FILTER (cap >= own * weight) OVER ()) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST(CAST(concat('0x', substr(md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

ORACLE_SQL = {"op2_warc_segments": OP2_SQL, "op6_grace_exact": OP6_SQL, "op7_mix_sources": OP7_SQL}
