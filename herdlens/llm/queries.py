"""One query for each text operator, over the whole of its table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.llm import oracles
from herdlens.llm.alignment import aligned
from herdlens.llm.chat import chat_paths, linear_replies, masked_text, read_turns
from herdlens.llm.common import table
from herdlens.llm.decontaminate import contamination
from herdlens.llm.fingerprints import as_text, edited_likeness, likeness
from herdlens.llm.line_dedup import line_report
from herdlens.llm.near_dedup import class_of_each
from herdlens.llm.neighbours import nearest
from herdlens.llm.pieces import code_digests
from herdlens.llm.substring_dedup import repeated_runs
from herdlens.llm.token_files import read_token_files, write_token_files
from herdlens.llm.toxicity import THRESHOLD, fit, held_out, with_score
from herdlens.llm.url_filters import judged
from herdlens.llm.whitening import whiten
from herdlens.session import materialize

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of near duplicates."""
    return class_of_each(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as piece ids and decoded again: digests of both."""
    return code_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_TOKENIZER), ["doc_id"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat passages of earlier text: the byte ranges and where they come from."""
    found = repeated_runs(table(spark, sf_dir, "documents"))
    sizes = F.transform("runs", lambda r: r["end"] - r["start"])
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_bytes"),
        F.array_sort(F.array_distinct("runs.source_id")).alias("source_ids"),
        "runs",
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items whose passages they hold."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by rules and, beyond them, by the templates of their host."""
    return judged(table(spark, sf_dir, "pages"), URL_RULES)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier runs of lines."""
    return line_report(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted as chats, and what reading them back gives."""
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("bigint"), "id", role, F.lit(said))
    replies = materialize(linear_replies(rows.union(more)), "chat-replies")
    chats = chat_paths(replies).join(replies.select(F.col("node").alias("root"), "conv_id"), "root")
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a score for toxicity, learned without the held-out labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    scored = with_score(docs.select("doc_id", "text"), model, "text")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how alike they are."""
    pairs = edited_likeness(table(spark, sf_dir, "documents"))
    own, edited, following = (F.col(c) for c in ("vector", "edited_vector", "next_vector"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        F.col("next_id").alias("next_doc_id"),
        F.col("next_chars").alias("next_n_chars"),
    )


def _crc32(ids) -> tuple:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files, read back: place, length and checksum of each."""
    folder = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return read_token_files(spark, folder, _crc32, "ids_crc32 bigint")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens in two vocabularies aligned, and counts of the linked pairs."""
    files = [public_tokenizers.path(name) for name in (BYTE_TOKENIZER, PIECE_TOKENIZER)]
    return aligned(table(spark, sf_dir, "documents"), *files)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of largest cosine for each row whose id is divisible by 50."""
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened by the covariance of their distinct grid vectors."""
    done = whiten(table(spark, sf_dir, "embeddings"), "embedding", keep=["vec_id"])
    parts = F.posexplode(F.arrays_zip("whitened", "explained"))
    each = done.select("row.vec_id", "n", "deviation", "identity_error", parts.alias("at", "part"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"),
        "identity_error",
    )


def llm_queries() -> dict:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_pieces": op2_pieces,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_url_filters": op5_url_filters,
        "op6_line_dedup": op6_line_dedup,
        "op7_chat": op7_chat,
        "op8_toxicity": op8_toxicity,
        "op9_fingerprints": op9_fingerprints,
        "op10_token_files": op10_token_files,
        "op11_alignment": op11_alignment,
        "op12_neighbours": op12_neighbours,
        "op13_whitening": op13_whitening,
    }


def llm_oracles() -> dict:
    return dict(oracles.ALL)
