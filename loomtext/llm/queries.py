"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import language, licenses, mixing, packing, pii, sharding, simhash, toxicity, vectors
from loomtext.sources.tables import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a table scan has the same partitions each time
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), stable=True)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stated query set against all rows
    return vectors.exact_top_k(read_table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 50 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vector_classes(read_table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_topk": op3_topk,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

#: Token count of a text as the operators count it: runs of anything but white space.
_TOKENS = r"len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> ''))"
_HASH = "('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"
_UNIT = "embedding::DOUBLE[]"
_COSINE = """round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6)"""

ORACLE_SQL: dict[str, str] = {
    "op3_topk": f"""
        WITH v AS (SELECT vec_id, {_UNIT} AS v FROM embeddings),
        ranked AS (
            SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, {_COSINE} AS similarity,
                   (row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id))::INT AS rank
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, rank, neighbor_id, similarity FROM ranked WHERE rank <= 10""",
    "op4_mixing": f"""
        WITH items AS (
            SELECT doc_id, coalesce(source, '') AS source, {_TOKENS} AS tokens, {_HASH} AS hash FROM documents),
        totals AS (SELECT source, sum(tokens)::BIGINT AS n, pow(sum(tokens)::DOUBLE, 0.7) AS raw FROM items GROUP BY source),
        shares AS (SELECT source, n, raw / (SELECT sum(raw) FROM totals) AS w FROM totals WHERE n > 0),
        most AS (SELECT min(n / w) AS m FROM shares),
        budgets AS (
            SELECT source, tier, least(n, floor(m * w * f + 1e-9))::BIGINT AS budget
            FROM shares, most, (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 1.0::DOUBLE)) AS t(tier, f)),
        running AS (
            SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto FROM items)
        SELECT r.doc_id, r.source, r.tokens, min(b.tier) AS tier
        FROM running r JOIN budgets b ON r.source = b.source AND r.upto <= b.budget
        GROUP BY r.doc_id, r.source, r.tokens""",
    "op7_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT DISTINCT vec_id, {_UNIT} AS v FROM embeddings),
        near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE {_COSINE} >= 0.98),
        reach AS (SELECT vec_id, vec_id AS class_id FROM v UNION SELECT r.vec_id, n.b FROM reach r JOIN near n ON r.class_id = n.a)
        SELECT r.vec_id, min(r.class_id) AS class_id, (SELECT count(*) FROM near n WHERE n.a = r.vec_id) AS links FROM reach r GROUP BY r.vec_id""",
}
