"""Line deduplication by winnowing.

A document is a sequence of lines. Every window of ``size`` consecutive lines
gives its smallest line hash (the last of equals) as a fingerprint, so wherever
two runs of ``size`` or more lines are equal they have a fingerprint in common,
at the same place of the run. The steps:

1. Select fingerprints and count them over all documents; one that occurs once
   cannot lie in a repeated run.
2. Join the positions of the repeated ones with their counts, and extend each
   both ways within its documents: the windows around it that selected it, by
   the digest of their lines.
3. The earliest occurrence of each such window, by document and line, is its
   source. A window with an earlier source is a repeat; repeats that touch are
   one run, which reaches as far as the lines go on being repeats. Its lines go.

So a line is deleted if and only if it lies in ``size`` consecutive lines that
stand earlier, in an earlier document or further up. A group of equal windows is
one row with its earliest place: no pairs are made, and a run that a third of all
documents share is counted before it is shuffled.

Defined results: earlier means a smaller ``doc_id`` (null first), for equal ids a
smaller digest of the text; rows that agree in both are one document and keep the
same lines; a null text has no lines and stays null; an empty text is one empty line; texts of fewer than
``size`` lines never change; a document can lose all lines and then has the
empty text, but it stays; an empty table gives no rows; further columns,
whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import packed
from herdlens.session import materialize

SIZE = 3


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` with their text and a digest of id and text."""
    text = F.col(text_col).cast("string")
    digest = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text).cast("binary")))
    return packed(docs, text=text, doc_id=F.col(id_col), digest=digest)


def _lines(placed: DataFrame) -> DataFrame:
    return placed.where("text IS NOT NULL").select("doc_id", "digest", F.split("text", "\n").alias("lines"))


def fingerprints(lines: DataFrame, size: int) -> DataFrame:
    """``(doc_id, digest, at, mark, key)``: a row for each window of lines.

    ``mark`` is the window's fingerprint, its smallest line hash; ``key`` is the
    digest of the window's lines with the fingerprint's place in it.
    """
    hashed = lines.where(F.size("lines") >= size).select(
        "doc_id", "digest", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes")
    )

    def window(i):
        low = F.array_min(F.slice("hashes", i + 1, size))
        place = F.lit(size) - F.array_position(F.reverse(F.slice("hashes", i + 1, size)), low)
        text = F.concat(place.cast("string"), F.lit("\n"), F.array_join(F.slice("lines", i + 1, size), "\n"))
        return F.struct(i.alias("at"), low.alias("mark"), F.unhex(F.md5(text.cast("binary"))).alias("key"))

    windows = F.transform(F.sequence(F.lit(0), F.size("hashes") - size), window)
    return hashed.select("doc_id", "digest", F.explode(windows).alias("w")).select("doc_id", "digest", "w.*")


def repeated_windows(lines: DataFrame, size: int = SIZE) -> DataFrame:
    """``(digest, at, source)`` of every window that stands earlier; ``source`` is where.

    Lookups have one row for each key and are written before they are joined, so
    that adaptive execution finds a shuffle right below both sides and can split
    a mark or a window that very many documents have.
    """
    windows = fingerprints(lines, size)
    common = windows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    candidates = materialize(windows.join(materialize(common, "line-marks"), "mark", "left_semi"), "line-windows")
    place = F.struct("doc_id", "digest", "at")
    earliest = candidates.groupBy("key").agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n"))
    sources = materialize(earliest.where("n > 1").drop("n"), "line-sources")
    return candidates.join(sources, "key").where(place != F.col("source")).select("doc_id", "digest", "at", "source")


def repeated_runs(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, from_line, n_lines, source_id)``: the runs that line deduplication deletes.

    ``source_id`` is the document where the run's first window stands first.
    """
    repeats = repeated_windows(_lines(_placed(docs, id_col, text_col)), size)
    window = F.struct("at", F.col("source.doc_id").alias("source_id"))
    each = repeats.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(window)).alias("w"))
    first = F.filter("w", lambda x, i: (i == 0) | (x["at"] - F.get("w", i - 1)["at"] > size))
    last = F.filter("w", lambda x, i: (i == F.size("w") - 1) | (F.get("w", i + 1)["at"] - x["at"] > size))
    runs = each.select("doc_id", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("r"))
    return runs.select(
        "doc_id", F.col("r.first.at").alias("from_line"),
        (F.col("r.last.at") - F.col("r.first.at") + size).alias("n_lines"), F.col("r.first.source_id").alias("source_id"),
    )


def _kept(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` in a struct ``row``, with the kept text and the deleted lines."""
    placed = _placed(docs, id_col, text_col)
    repeats = repeated_windows(_lines(placed), size)
    starts = materialize(repeats.groupBy("digest").agg(F.collect_set("at").alias("starts")), "line-repeats")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + size - 1))))
    # The same join for every size: the texts are shuffled once, inside their rows.
    joined = placed.select("row", "digest").join(starts.hint("merge"), "digest", "left")
    joined = joined.withColumn("text", F.col(f"row.`{text_col}`").cast("string")).select(
        "row", "text", F.split("text", "\n").alias("lines"), F.when(F.col("starts").isNotNull(), covered).alias("covered")
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")
    rest = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(rest).alias("kept"),
        F.coalesce(F.size(F.col("lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(F.col("covered")), F.lit(0)).cast("bigint").alias("n_deleted"),
    )


def _row(docs: DataFrame, text_col: str, text: Column) -> list:
    return [(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def without_repeated_lines(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later repeats of runs of ``size`` or more lines taken out of the text.

    All columns and rows stay, in their places.
    """
    return _kept(docs, size, id_col, text_col).select(*_row(docs, text_col, F.col("kept")))


def line_report(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_deleted, text)`` of every document, the text as it stays."""
    kept = _kept(docs, size, id_col, text_col)
    return kept.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n_lines", "n_deleted", F.col("kept").alias("text"))
