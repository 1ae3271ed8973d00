"""Documents through the text operators, one written stage after another.

Each stage takes ``(spark, docs, sf_dir)``, works on every row of ``docs`` and
returns a DataFrame; all but the last return the columns of ``docs``. Toxic
documents go, then runs of lines that stand earlier, then all but one document of
each class of near duplicates, then documents that hold a window of a benchmark
item; what is left becomes piece ids and is decoded again. A document whose lines
are all repeats stays as an empty text, and the near-duplicate stage keeps one of
those. Nulls, empty tables and further columns are treated as the operators say.

Executors keep what they once took from stage to stage, so all stages hand texts to
Python in batches a quarter as large as the operators do by themselves.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.llm.common import BATCH_BYTES, bounded_batches, table
from herdlens.llm.decontaminate import without_leaks
from herdlens.llm.line_dedup import without_repeated_lines
from herdlens.llm.near_dedup import one_of_each
from herdlens.llm.pieces import code_and_decode
from herdlens.llm.toxicity import held_out, without_toxic
from herdlens.session import materialize


def small_batches(stage):
    """The stage with batches of at most a quarter of ``BATCH_BYTES``."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark, BATCH_BYTES // 4)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    return without_toxic(docs, table(spark, sf_dir, "labels").where(~held_out()))


@small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier runs; ``n_chars`` is counted again."""
    kept = without_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    kind = docs.schema["n_chars"].dataType
    return kept.withColumn("n_chars", F.char_length("text").cast(kind))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every document."""
    coded = code_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: Scores, alignments and tokenizers have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
