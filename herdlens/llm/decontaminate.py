"""Benchmark passages in documents, by a distributed positional index.

Words of a text are the runs of letters and digits after lower-casing A-Z; a
window is ``size`` consecutive words of a benchmark item (all of a shorter
item). The steps:

1. Count how often each benchmark word occurs in all documents.
2. Each window is looked up by its two rarest words. A window with a word that
   no document has is left out, as it cannot occur.
3. Store the postings of those rare words: document, position, and the words
   around the position (``size - 1`` on either side).
4. Move postings by their word's place in the item: postings of one phrase then
   agree on where the item would begin. Intersect the lists of both rare words
   on that place, and compare the whole window with the words stored beside the
   rarest one. Within ``slop`` words instead of exactly: proximity matches.

What is sent to the tasks that read documents is a bit map of fixed size (which
hashes rare words have), however large the benchmark is; more words only let more
postings through. Nothing else is broadcast by hand.

Defined results: a null or wordless text has no words and no hits; a null item
text has no windows; items with the same id are one item and a null id is the item
``null``; repeated documents are judged one by one; with an empty table on either
side nothing is hit; other columns are ignored (or kept, by
:func:`without_leaks`). Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdlens.llm.common import bounded_batches, packed, text_of
from herdlens.session import materialize

SIZE = 10
SLOTS = 1 << 22  # bits of the map of rare words

#: Every byte that is not part of a word becomes a space; A-Z become a-z. Bytes
#: from 128 belong to longer characters, which are all part of words.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list:
    return text.translate(TO_WORDS).split()


def _texts(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _word_lists(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, words)`` of every benchmark item with words."""

    def split(batches):
        for batch in batches:
            words = [[w.decode() for w in words_of(t)] for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(words, pa.list_(pa.string()))], names=["item", "words"]
            )

    item = F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item")
    texts = items.select(item, text_of(text_col).alias("text"))
    return texts.mapInArrow(split, "item string, words array<string>").where("size(words) > 0")


def _windows(lists: DataFrame, size: int) -> DataFrame:
    """``(unit, item, begin, window)``: ``unit`` tells apart items with one id."""
    last = F.greatest(F.size("words") - size, F.lit(0))
    window = lambda i: F.struct(i.alias("begin"), F.slice("words", i + 1, size).alias("window"))
    cut = F.explode(F.transform(F.sequence(F.lit(0), last), window))
    return lists.select(F.monotonically_increasing_id().alias("unit"), "item", cut.alias("w")).select("unit", "item", "w.*")


def _bit_map(words: DataFrame) -> bytes:
    """Which of ``SLOTS`` hashes the words have; at most ``SLOTS / 32`` rows reach the driver."""
    slot = F.crc32(F.encode("word", "utf-8")) % SLOTS
    cells = words.select(slot.alias("s")).groupBy((F.col("s") / 32).cast("int").alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("s") % 32).cast("int"))).alias("bits")
    )
    found = np.zeros(SLOTS // 32, "<u4")
    for cell, bits in cells.collect():
        found[cell] = bits
    return found.tobytes()


def _listed(bits: bytes):
    """Whether the map has a word."""

    def test(word: bytes) -> bool:
        slot = zlib.crc32(word) & (SLOTS - 1)
        return bits[slot >> 3] >> (slot & 7) & 1 == 1

    return test


def word_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``(word, n)``: occurrences in all ``texts`` of each of the distinct ``words``."""
    bits = texts.sparkSession.sparkContext.broadcast(_bit_map(words))  # SLOTS / 8 bytes

    def count(batches):
        listed = _listed(bits.value)
        for batch in batches:
            seen = Counter()
            for text in _texts(batch.column("text")):
                seen.update(words_of(text))
            kept = [(w.decode(), n) for w, n in seen.items() if listed(w)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
                names=["word", "n"],
            )

    counts = texts.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def anchored_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows that can occur, with the places in the item of their two rarest words."""
    each = windows.select("*", F.posexplode("window").alias("place", "word")).join(counts, "word")
    rare = F.sort_array(F.collect_list(F.struct("n", "place", "word")))  # at most a window's words
    return (
        each.groupBy("unit", "item", "begin")
        .agg(rare.alias("rare"), F.first("window").alias("window"))
        .where("rare[0].n > 0")
        .select(
            "unit", "item", "begin", "window",
            F.col("rare")[0]["word"].alias("first_word"),
            (F.col("begin") + F.col("rare")[0]["place"]).alias("first_at"),
            F.get("rare", F.lit(1))["word"].alias("second_word"),
            (F.col("begin") + F.get("rare", F.lit(1))["place"]).alias("second_at"),
        )
    )


POSTINGS = "array<struct<word: string, at: int, from: int, around: string>>"


def positional_index(texts: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """A written row for each document: ``(doc, doc_id, n_words, postings)``.

    ``anchors`` has the words whose postings are stored.
    """
    bits = texts.sparkSession.sparkContext.broadcast(_bit_map(anchors))  # SLOTS / 8 bytes

    def index(batches):
        listed, base, row = _listed(bits.value), TaskContext.get().partitionId() << 33, 0
        known: dict = {}
        for batch in batches:
            lengths, postings = [], []
            for text in _texts(batch.column("text")):
                words = words_of(text)
                lengths.append(len(words))
                for w in set(words).difference(known):
                    known[w] = listed(w)
                found = []
                for at, w in enumerate(words):
                    if known[w]:
                        start = max(0, at - size + 1)
                        around = b" ".join(words[start : at + size]).decode()
                        found.append({"word": w.decode(), "at": at, "from": start, "around": around})
                postings.append(found)
            if len(known) > 300_000:
                known = {}
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(base + row, base + row + n)), batch.column("doc_id"),
                    pa.array(lengths, pa.int64()), pa.array(postings, arrow),
                ],
                names=["doc", "doc_id", "n_words", "postings"],
            )
            row += n

    arrow = pa.list_(
        pa.struct([("word", pa.string()), ("at", pa.int32()), ("from", pa.int32()), ("around", pa.string())])
    )
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(index, f"doc bigint, doc_id {kind}, n_words bigint, postings {POSTINGS}")
    return materialize(rows, "postings")


def matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """``(doc, item, at, size, exact)``: windows found in documents, from the index.

    Exact matches are whole windows. With ``slop`` there are also proximity
    matches (``exact`` false): the window's two rarest words, each by at most
    ``slop`` words away from where the other one would have it.
    """
    places = windows.select("first_word", "unit", "first_at").union(
        windows.where("second_word IS NOT NULL").select("second_word", "unit", "second_at")
    ).toDF("word", "unit", "place").distinct()
    # Lists of bare positions are intersected; the words around them come last.
    postings = index.select("doc", F.explode("postings").alias("p")).select("doc", "p.word", "p.at")
    moved = postings.join(places, "word").select("doc", "unit", "place", (F.col("at") - F.col("place")).alias("origin"))
    wanted = windows.select("unit", "item", "begin", "window", F.col("first_at").alias("place"), "second_at")
    several, alone = wanted.where("second_at IS NOT NULL"), wanted.where("second_at IS NULL")
    columns = ["doc", "unit", "item", "begin", "window", "origin", "place", "other"]
    if slop == 0:
        lists = moved.groupBy("doc", "unit", "origin").agg(F.collect_set("place").alias("places")).where("size(places) > 1")
        first = lists.select("*", F.explode("places").alias("place"))
        pairs = first.join(several, ["unit", "place"]).where("array_contains(places, second_at)")
        pairs = pairs.withColumn("other", F.col("origin"))
    else:
        width = slop + 1
        cell = F.floor(F.col("origin") / width)
        first = moved.withColumn("cell", cell).join(several, ["unit", "place"])
        second = moved.select("doc", "unit", F.col("place").alias("second_at"), F.col("origin").alias("other")).distinct()
        near = F.floor(F.col("other") / width)
        second = second.withColumn("cell", F.explode(F.array(near - 1, near, near + 1)))
        pairs = first.join(second, ["doc", "unit", "second_at", "cell"]).where(F.abs(F.col("origin") - F.col("other")) <= slop)
    single = moved.join(alone, ["unit", "place"]).withColumn("other", F.col("origin"))
    found = pairs.select(*columns).union(single.select(*columns)).withColumn("posted", F.col("origin") + F.col("place"))
    around = index.select("doc", F.explode("postings").alias("p")).select(
        "doc", F.col("p.at").alias("posted"), F.col("p.from").alias("from"), "p.around"
    )
    at = (F.col("origin") + F.col("begin")).cast("int")
    inside = (at >= F.col("from")) & (F.col("other") == F.col("origin"))
    words = F.split("around", " ")
    shown = F.when(inside, F.slice(words, F.greatest(at - F.col("from"), F.lit(0)) + 1, F.size("window")))
    result = found.join(around, ["doc", "posted"]).select(
        "doc", "item", at.alias("at"), F.size("window").alias("size"),
        F.coalesce(shown == F.col("window"), F.lit(False)).alias("exact"),
    )
    if slop == 0:
        result = result.where("exact")
    return result.groupBy("doc", "item", "at", "size").agg(F.max("exact").alias("exact"))


def benchmark_index(
    docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The positional index of ``docs`` for ``items``, and the windows it was made for."""
    bounded_batches(docs.sparkSession)
    windows = materialize(_windows(_word_lists(items, item_col, item_text_col), size), "windows")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    words = windows.select(F.explode("window").alias("word")).distinct()
    anchored = materialize(anchored_windows(windows, word_counts(texts, words)), "anchored-windows")
    rare = anchored.select(F.explode(F.array_compact(F.array("first_word", "second_word"))).alias("word")).distinct()
    return positional_index(texts, rare, size), anchored


def contamination(
    docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` of every document; ``items`` in order, as strings."""
    index, windows = benchmark_index(docs, items, size, id_col, text_col, item_col, item_text_col)
    found = matches(index, windows)
    ends = F.col("at") + F.col("size")
    before = Window.partitionBy("doc").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    places = found.groupBy("doc", "at", "size").agg(F.collect_set("item").alias("items"))
    new = ends - F.greatest(F.col("at"), F.coalesce(F.max(ends).over(before), F.col("at")))
    hit = places.withColumn("new", F.greatest(new, F.lit(0))).groupBy("doc").agg(
        F.sum("new").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return index.select("doc", "doc_id", "n_words").join(hit, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, size: int = SIZE, text_col: str = "text", **names) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no window of an item."""
    rows = packed(docs, text=text_of(text_col), digest=F.md5(text_of(text_col).cast("binary")))
    judged = contamination(rows.select(F.col("digest").alias("doc_id"), "text"), items, size, **names)
    leaking = judged.where("n_hit > 0").select(F.col("doc_id").alias("digest")).distinct()
    return rows.join(leaking, "digest", "left_anti").select("row.*")
