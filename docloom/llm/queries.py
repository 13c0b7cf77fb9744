"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, classifier, id_files, main_text, neighbours, packing, pii, prefix_trie, rules, simhash, token_counts, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, _read(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(_read(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_read(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(_read(spark, sf_dir, "documents"))


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_token_counts,
        op3_pii,
        op4_packing,
        op5_quality_rules,
        op6_neighbours,
        op7_bpe_round_trip,
        op8_warc,
        op9_simhash,
        op10_main_text,
        op11_prefix_trie,
        op12_alignment,
        op13_id_files,
    )
}

#: A SHA-1's 40 hex digits, five at a time, as four digits of base 32.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {5 * k + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31)::INT, 1)"
    for k in range(8)
    for j in range(4)
)

ORACLE_SQL: dict[str, str] = {
    "op8_warc": f"""
        WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
        kept AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM payloads)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to
        FROM kept""",
    "op11_prefix_trie": """
        WITH crc_table AS (SELECT [list_reduce([i] || range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FOR i IN range(256)] AS t),
        turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM turns),
        crcs AS (SELECT conv_id, base, xor(list_reduce([4294967295] || [ord(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')], lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 4 AS h FROM ids, crc_table),
        rebuilt AS (SELECT c.conv_id, 0 AS own, p, role, text FROM crcs c JOIN turns t ON t.conv_id = c.base WHERE p <= h
            UNION ALL SELECT c.conv_id, 1, p, role, text FROM crcs c JOIN turns t ON t.conv_id = c.conv_id WHERE p > h),
        paths AS (SELECT conv_id, text, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY own, p) AS path FROM rebuilt
            UNION ALL SELECT conv_id, '', [] FROM ids),
        lens AS (SELECT conv_id, max(len(path)) AS n FROM paths GROUP BY 1),
        nodes AS (SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS saving,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = n), '') AS ends FROM paths JOIN lens USING (conv_id) GROUP BY 1, 2),
        parents AS (SELECT c.path, p.conv_id AS parent_conv_id FROM nodes c JOIN nodes p ON c.depth > 0 AND p.path = c.path[:c.depth - 1]),
        children AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        above AS (SELECT path[:d] AS path, sum(saving)::BIGINT AS saved_tokens, (count(*) FILTER (n_children IS NULL))::BIGINT AS n_leaves
            FROM (SELECT n.path, saving, n_children, unnest(range(depth + 1)) AS d FROM nodes n LEFT JOIN children USING (path)) GROUP BY 1)
        SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
        FROM nodes LEFT JOIN parents USING (path) LEFT JOIN children USING (path) JOIN above USING (path)""",
}
