"""The registered query of each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import graph_ann, license_scan, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, warc

#: The model of op9 and of the pipeline's last stage; the file is read where it is installed.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.apply(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages")).where("not gap")
    return found.select(
        warc.page_number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    return out.select("doc_id", "n_pieces", "ids_digest", "round_trip")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), extend=True)
    return out.select("doc_id", "n_removed_lines", "n_removed_chunks", F.sha1(F.encode("text", "utf-8")).alias("text_digest"))


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.apply(docs, mixing.label_domains(table(spark, sf_dir, "labels")))
    return out.withColumnsRenamed({f"p_{k}": f"p_{name}" for k, name in enumerate(mixing.DOMAINS)})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("k").alias("doc_id"), F.col("first_k").alias("first_doc_id"), F.col("start").alias("start_byte"), F.col("size").alias("n_bytes"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_ann": op1_graph_ann,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc": op8_warc,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES: dict[str, str] = {"op4_license_scan": license_scan.oracle_sql(), "op8_warc": OP8_SQL}
