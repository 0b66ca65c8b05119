"""From raw documents to packed sequences: quality, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import linededup, minhash, mixing, packing, quality
from granary.llm.common import released, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels table."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, of any length but blank ones. One that has lost every line is gone; an empty one stays as it was."""
    out = linededup.line_dedup(docs, exact_chars=1).where((F.col("n_lines") == 0) | (F.col("n_exact") + F.col("n_near") < F.col("n_lines")))
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return minhash.dedup(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the mix's order."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens, filled in the order of the mix (of the files read)."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), in_order=True)


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: No SQL: training, minhashes and tokens can't be told in it. The operators are held against brute force in their tests, the stages against what they promise of their own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the documents table; each stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = staged(stage(spark, docs, sf_dir), name), docs
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
