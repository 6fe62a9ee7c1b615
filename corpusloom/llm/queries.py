"""The queries of this folder's operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_lexicon, hnsw, jaccard_join, license_scan, line_dedup, packing, quality_crf, secret_scan, suffix_dedup, toxicity
from .common import load


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_crf.rate(docs, quality_crf.fit(docs, load(spark, sf_dir, "labels")))


def op2_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op4_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.passages(load(spark, sf_dir, "documents"))


def op3_line_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_jaccard_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(load(spark, sf_dir, "documents"))


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.round_trip(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(load(spark, sf_dir, "documents")))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def fold_of(column: str = "doc_id"):
    """Remainder by 5 of the CRC-32 of an id as text: rows with 0 are held out."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5))


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), where=fold_of() != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_lines": op1_quality_lines,
    "op2_hnsw_shards": op2_hnsw_shards,
    "op3_line_cuckoo": op3_line_cuckoo,
    "op4_license_dice": op4_license_dice,
    "op4_license_passages": op4_license_passages,
    "op5_jaccard_product": op5_jaccard_product,
    "op6_bpe_lexicon": op6_bpe_lexicon,
    "op7_linked_secrets": op7_linked_secrets,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_previous_factors": op9_previous_factors,
    "op10_string_kernel": op10_string_kernel,
}

ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_product": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
        SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
        FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op4_license_dice": license_scan.oracle_sql(),
    "op3_line_cuckoo": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        line AS (
          SELECT r, doc_id, u.k, u.line, lower_ascii.t AS key
          FROM d,
               LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                               generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS k) u,
               LATERAL (SELECT translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t) lower_ascii),
        hot AS (SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
               CAST(count(*) FILTER (WHERE key IN (SELECT key FROM hot)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
        FROM line GROUP BY r, doc_id""",
}
