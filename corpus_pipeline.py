"""Five stages from raw documents to packed sequences; each works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import decontamination, line_dedup, minhash, packing, toxicity
from pricetide.llm.common import stored, table
from pricetide.llm.queries import tokenizer_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Near copies have so much of the union of their shingle sets in common.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The network is fitted on labelled rows of `documents` outside the held-out fold."""
    network = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), network).filter("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occurred before; those of which nothing is left go."""
    kept = line_dedup.dedup_lines(docs, removed="n_removed").filter((F.col("n_removed") == 0) | (F.btrim("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Documents without an id stay.

    Links are those of NEAR_PERCENT, which is less strict than the default of `op1_minhash_bayes`.
    """
    gone = minhash.near_duplicates(docs, percent=NEAR_PERCENT).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.packed_documents(docs, *tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Scores of a trained network and token ids are not SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
