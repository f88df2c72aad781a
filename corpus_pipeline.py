"""A corpus from ``documents`` to token ids, in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from opsloom.llm.common import saved
from opsloom.llm.queries import PIECE_MODEL, table

#: Shares of expected tokens that the mixture has from documents that are not toxic, and from toxic ones.
MIX = (0.98, 0.02)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filtered(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut from the texts; ``n_chars`` follows a text that has changed. All rows stay."""
    out = line_dedup.apply(docs, extend=True)
    n_chars = F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id."""
    return ngram_join.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says, so that the domains' expected tokens match MIX.

    The quality rules have taken the domain of low quality away; what is left is mixed by toxicity. A target for that
    domain could only be met by repeating the few texts that look a little like it.
    """
    return mixing.mixed(docs, mixing.toxic_domains(table(spark, sf_dir, "labels")), MIX)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids and their number; both are null for a null text."""
    out = sentencepiece_codec.encode(docs.select("doc_id", "text"), PIECE_MODEL)
    return out.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: EM, content-defined chunks and piece segmentation are no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
