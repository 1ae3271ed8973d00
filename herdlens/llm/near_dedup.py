"""Near-duplicate documents by order MinHash and banded alignment.

Words are the runs of a text between white space, in lower case. A text's k-mers
are its runs of ``K`` words, each labelled with how often it has occurred before,
so that repeats count; short texts have k-mers of fewer words (``SHORT``), and those
near such a bound both kinds. For each of ``SKETCHES`` hash functions the ``PICKED``
smallest labelled k-mers are taken and kept in the order of the text: two texts
agree in such a mark about as often as they can be aligned, not only as often as
they share words (Marçais et al., 2019). Texts with a mark in common are
candidates; they are duplicates if an alignment of their words needs edits
(insert, delete, replace) for at most 1 - ``SIMILARITY`` of the longer one's
words. A class is all documents connected by such links.

How it stays bounded:

* Copies (equal texts) are one text, represented by a digest.
* Within a mark each text is compared with one leader, the text of the least
  number, so a mark with n texts costs n - 1 comparisons and not n^2 / 2.
* What the leaders have linked is contracted to parts. Texts of different parts that
  still share a mark are compared by bit signatures of their labelled words, which
  bound their edits from below (an exact filter): only pairs that may be alike become
  rows, each once, and are aligned. The texts of a leader's marks are dealt in
  blocks, and tasks compare one pair of blocks; a block is a bounded share of all
  rows, so what is sent grows with the input. The number of bit comparisons still
  grows with the square of a group in which no text is like the leader.
* Alignments keep to a band around the diagonal, wider only while needed, one bit
  for each cell; a pair that can no longer reach the similarity is left early.

Defined results: null counts as the empty text, all of which are one class; a text
of fewer words than a k-mer is one k-mer; the class id is the least ``doc_id`` of
the class (null only if all ids in it are null); repeated rows are copies; an
empty table gives no rows; other columns are ignored, or kept by
:func:`one_of_each`.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import bounded_batches, packed, text_of
from herdlens.operators.components import connected_components
from herdlens.operators.skew import lookup_join
from herdlens.session import materialize

K = 3
SIMILARITY = 0.8
SKETCHES = 64
PICKED = 2
SHORT = (12, 40)  # up to so many words texts have marks of one word, of two words
SMALL = 512  # rows of a block at least; of large inputs a block has one row in SHARE
SHARE = 512
BITS = 4  # of a signature for each word, at least, up to SIGNED bits
SIGNED = 1 << 17
TOGETHER = 64  # texts compared at once with the others of a pair of blocks
MASK = (1 << 64) - 1
KEPT = 300_000  # words whose hash a worker remembers


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple:
    """Odd factors and offsets of ``n`` hash functions, from digests of their numbers."""

    def number(text: str) -> int:
        return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")

    factors = np.array([number(f"factor {i}") | 1 for i in range(n)], np.uint64)
    return factors, np.array([number(f"offset {i}") for i in range(n)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of word hashes, each with its occurrence number."""
    n = len(words)
    k = min(k, n)
    sums = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
    sums = _mixed(sums)
    order = np.argsort(sums, kind="stable")
    ordered = sums[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return _mixed(sums)
    place = np.arange(len(sums))
    number = place - np.maximum.accumulate(np.where(new, place, 0))
    occurrence = np.empty(len(sums), np.uint64)
    occurrence[order] = number.astype(np.uint64)
    return _mixed(sums + occurrence * np.uint64(0xD6E8FEB86659FD93))


def order_sketch(words: np.ndarray, k: int = K, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """A mark for each hash function: its smallest k-mers, in the order of the text."""
    if not len(words):
        return np.zeros(sketches, np.int64)
    kmers = labelled_kmers(words, k)
    factors, offsets = _functions(sketches)
    marks = np.empty(sketches, np.uint64)
    step = max(1, (1 << 20) // len(kmers))  # functions at once, by memory
    for first in range(0, sketches, step):
        last = min(first + step, sketches)
        values = (kmers[None, :] ^ offsets[first:last, None]) * factors[first:last, None]
        rows, places = np.arange(last - first), []
        for _ in range(min(picked, len(kmers))):
            least = values.argmin(axis=1)
            places.append(least)
            values[rows, least] = np.uint64(MASK)
        mark = offsets[first:last].copy()
        for at in np.sort(np.array(places), axis=0):
            mark = _mixed(mark * np.uint64(0x9E3779B97F4A7C15) + kmers[at])
        marks[first:last] = mark
    return marks.view(np.int64)


def sizes_of(n: int, k: int = K, similarity: float = SIMILARITY) -> list:
    """Sizes of the k-mers that a text of ``n`` words gives marks of.

    Two texts that can be alike by their lengths have a size in common: that of the longer one.
    """
    tops = [*SHORT[: k - 1], float("inf")]
    lows = [0, *(similarity * (top + 1) - 1e-9 for top in tops)]
    sizes = [*range(1, len(tops)), k]
    return [size for size, low, top in zip(sizes, lows, tops, strict=False) if low <= n <= top]


def sketch_of(words: np.ndarray, k: int, sketches: int, picked: int, similarity: float) -> np.ndarray:
    """The marks of a text, for every size of its k-mers."""
    marks = [order_sketch(words, size, sketches, picked) for size in sizes_of(len(words), k, similarity)]
    return np.concatenate(marks)


def signature_of(words: np.ndarray) -> bytes:
    """For each hash slot whether it holds an odd number of a text's labelled words.

    Two texts differ in no more slots than in labelled words. The slots are a power
    of two, so a signature can be folded to the size of a shorter one.
    """
    slots = 64
    while slots < min(BITS * len(words), SIGNED):
        slots *= 2
    if not len(words):
        return bytes(slots // 8)
    held = np.bincount((labelled_kmers(words, 1) % np.uint64(slots)).astype(np.int64), minlength=slots)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(signatures: np.ndarray, size: int) -> np.ndarray:
    while signatures.shape[1] > size:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def _matrix(signatures: list) -> np.ndarray:
    """Signatures in order of size as rows of 64-bit numbers, folded to the size of the first."""
    size = len(signatures[0]) // 8
    blocks = [np.frombuffer(b"".join(s), "<u8").reshape(-1, n // 8) for n, s in groupby(signatures, len)]
    return np.concatenate([_folded(b, size) for b in blocks])


def close_pairs(sizes: np.ndarray, parts: np.ndarray, blocks: np.ndarray, signatures: list, similarity: float):
    """Places of texts, in arrays of pairs, that are of different parts and may be alike.

    Rows are in order of ``sizes``, their numbers of words; if they are of two
    ``blocks``, pairs are of both. An alignment with ``e`` edits leaves unmatched at most
    ``e`` words of the longer text, and of the shorter one as many fewer as it is shorter.
    """
    edits = np.floor((1 - similarity) * sizes + 1e-9).astype(np.int64)
    least, place, crossed = sizes - edits, np.arange(len(sizes)), blocks.min() < blocks.max()
    for first in range(0, len(sizes), TOGETHER):
        last = min(first + TOGETHER, len(sizes))
        end = int(np.searchsorted(least, sizes[last - 1], "right"))
        mine, others = slice(first, last), slice(first, end)
        open_ = (parts[mine, None] != parts[others]) & (place[mine, None] < place[others]) & (sizes[mine, None] >= least[others])
        if crossed:
            open_ &= blocks[mine, None] != blocks[others]
        if not open_.any():
            continue
        most = sizes[mine, None] - sizes[others] + 2 * edits[others]
        full = _matrix(signatures[first:end])
        short = _folded(full, max(1, full.shape[1] // 8))  # settles most pairs
        apart = np.zeros(open_.shape, np.int64)
        for word in short.T:
            apart += np.bitwise_count(word[: last - first, None] ^ word)
        u, v = np.nonzero(open_ & (apart <= most))
        step = max(1, (1 << 20) // full.shape[1])
        for at in range(0, len(u), step):
            a, b = u[at : at + step], v[at : at + step]
            near = np.bitwise_count(full[a] ^ full[b]).sum(axis=1, dtype=np.int64) <= most[a, b]
            yield a[near] + first, b[near] + first


def split_words(text: str) -> list:
    return text.lower().split()


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def of(self, text: str) -> np.ndarray:
        words = split_words(text)
        if len(self) > KEPT:
            self.clear()
        for w in [w for w in set(words) if w not in self]:  # difference() would walk through all of a subclass of dict
            self[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def edits_within(a: list, b: list, most: int) -> int | None:
    """Edits between two lists if they are at most ``most``, else None.

    Columns of the alignment's matrix as bit vectors of differences between
    neighbouring cells (Myers, 1999), cut to a band that moves along the
    diagonal (Hyyrö, 2003).
    """
    if len(a) < len(b):
        a, b = b, a
    first = 0
    while first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(b) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    longer = len(a) - len(b)
    if longer > most:
        return None
    if not b:
        return longer
    where: dict = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    if len(a) - _shared(a, b) > most:
        return None
    band = min(most, max(16, longer + 8))
    while True:
        found = _banded(where, b, longer, band)
        if found is not None or band >= most:
            return found
        band = min(most, 2 * band)


def _shared(a: list, b: list) -> int:
    """Words in common, repeats counted: no alignment can match more."""
    counts: dict = {}
    for word in a:
        counts[word] = counts.get(word, 0) + 1
    shared = 0
    for word in b:
        left = counts.get(word, 0)
        if left:
            counts[word] = left - 1
            shared += 1
    return shared


def _banded(where: dict, b: list, longer: int, band: int) -> int | None:
    """Edits along the band of ``band`` cells on either side, if no more than that."""
    mask = (1 << 2 * band + 1) - 1
    rising, falling = mask & ~((1 << band) - 1), 0
    ends_on, edits = longer + band, longer
    for j, word in enumerate(b):
        places = where.get(word, 0)
        equal = (places >> j - band if j >= band else places << band - j) & mask
        same = (((equal & rising) + rising) ^ rising | equal | falling) & mask
        up = (falling | ~(same | rising)) & mask
        down = same & rising
        if not same >> ends_on & 1:
            edits += 1
            if edits > band:
                return None
        same >>= 1
        rising, falling = (down | ~(same | up)) & mask, same & up
    return edits


def sketched(
    docs: DataFrame, id_col: str, text_col: str, k: int, sketches: int, picked: int, similarity: float = SIMILARITY
) -> DataFrame:
    """``(doc_id, key, sketch)`` of every document; ``key`` is a digest of its text."""
    bounded_batches(docs.sparkSession)

    def sketch(batches):
        known = _Hashes()
        for batch in batches:
            marks = [sketch_of(known.of(text), k, sketches, picked, similarity) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), _lists(marks)], names=["doc_id", "key", "sketch"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    keyed = rows.select("doc_id", _digest("text").alias("key"), "text")
    return keyed.mapInArrow(sketch, f"doc_id {kind}, key binary, sketch array<bigint>")


def _lists(arrays: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype="int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _digest(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)`` of the ``pairs`` whose texts can be aligned that well."""

    def align(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("a", "b"))
            keep = []
            for a, b in zip(left, right, strict=True):
                a, b = split_words(a), split_words(b)
                most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
                keep.append(edits_within(a, b, most) is not None)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a = texts.select(F.col("rid").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("rid").alias("v"), F.col("text").alias("b"))
    # Two equi-joins with one row for each key on the text side; texts are never broadcast.
    return pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("u", "v", "a", "b").mapInArrow(align, "u bigint, v bigint")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = K,
    sketches: int = SKETCHES, picked: int = PICKED,
) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``(doc_id, key)`` of the documents, ``(key, class, first_id)`` of the texts.

    ``class`` is the least document id of all texts in the class, ``best`` marks
    the one text that represents it.
    """
    members = materialize(sketched(docs, id_col, text_col, k, sketches, picked, similarity), "near-sketches")
    texts = materialize(
        members.groupBy("key")
        .agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "near-texts",
    )
    marks = texts.select(F.explode(F.array_distinct("sketch")).alias("mark"), "rid")
    leaders = materialize(
        marks.groupBy("mark").agg(F.min("rid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "near-leaders",
    )
    grouped = materialize(marks.join(leaders, "mark"), "near-groups")
    pairs = materialize(grouped.where("rid != leader").select(F.col("rid").alias("u"), F.col("leader").alias("v")).distinct(), "near-pairs")
    store = _text_store(docs, text_col, texts, pairs)  # the texts of all that share a mark
    links = materialize(verified(pairs, store, similarity), "near-links")
    # What is linked is one part, other texts one each.
    parts = materialize(connected_components(links).toDF("rid", "part"), "near-parts")
    parted = grouped.join(parts, "rid", "left").withColumn("part", F.coalesce("part", "rid"))
    more = _pairs_left(parted, store, similarity).join(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti"
    )
    more = materialize(verified(more, store, similarity), "near-links")
    links = parts.select(F.col("rid").alias("u"), F.col("part").alias("v")).unionByName(more)
    parts = connected_components(links).toDF("rid", "part")
    classed = texts.drop("sketch").join(parts, "rid", "left").withColumn("part", F.coalesce("part", "rid"))
    classed = materialize(classed, "near-classed")
    ids = classed.groupBy("part").agg(
        F.min("first_id").alias("class"), F.min_by("rid", F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("top")
    )
    classes = classed.join(materialize(ids, "near-ids"), "part").select("key", "first_id", "class", (F.col("rid") == F.col("top")).alias("best"))
    return members.select("doc_id", "key"), materialize(classes, "near-classes")


def _pairs_left(parted: DataFrame, store: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)``, u > v, each once: pairs of different parts that share a mark and may be alike.

    Pairs are looked for among the texts of a leader, block by block, and taken where
    their least common mark is one of that leader's.
    """
    parted = materialize(parted, "near-parted")
    sizes = parted.groupBy("mark").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    open_marks = materialize(sizes.where("low < high").select("mark"), "near-open")
    rows = materialize(parted.join(open_marks, "mark"), "near-rows")
    signed = _signed(store.join(rows.select("rid").distinct().hint("merge"), "rid"))
    marks = rows.groupBy("rid").agg(F.collect_set("mark").alias("marks"))
    stars = rows.groupBy("leader", "rid").agg(F.first("part").alias("part"), F.collect_set("mark").alias("here"))
    stars = materialize(stars, "near-stars")
    block_rows = max(SMALL, stars.count() // SHARE)
    counted = stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = lookup_join(stars, counted, ["leader"], "inner", broadcasts=False)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    dealt = lookup_join(dealt, signed.join(marks.hint("merge"), "rid"), ["rid"], "inner", broadcasts=False)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("leader", "block", other, "rid", "part", "n_words", "signature", "marks", "here")
    tiles = tiles.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    tiles = tiles.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "n_words")

    def compare(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy() for c in ("leader", "i", "j")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            last = int(ends[-1]) if len(ends) else 0  # the last pair of blocks may go on in the next batch
            if last:
                yield _compared(rows.slice(0, last), ends, similarity)
            rest = rows.slice(last)
        if rest is not None and rest.num_rows:
            yield _compared(rest, np.array([rest.num_rows]), similarity)

    return materialize(tiles.mapInArrow(compare, "u bigint, v bigint"), "near-pairs")


def _compared(rows: pa.Table, ends: np.ndarray, similarity: float) -> pa.RecordBatch:
    """The pairs left of ``rows``, in which pairs of blocks end at ``ends``."""
    rows = rows.combine_chunks()
    rid, part, block, sizes = (rows.column(c).to_numpy() for c in ("rid", "part", "block", "n_words"))
    sizes, signatures = sizes.astype(np.int64), rows.column("signature").to_pylist()
    marks, here = rows.column("marks"), rows.column("here")
    us, vs, first = [], [], 0
    for end in ends.tolist():
        tile = slice(first, end)
        if part[tile].min() < part[tile].max():
            for pair in close_pairs(sizes[tile], part[tile], block[tile], signatures[tile], similarity):
                for a, b in zip(*(x.tolist() for x in pair), strict=True):
                    shared = set(marks[first + a].as_py()).intersection(marks[first + b].as_py())
                    if shared and min(shared) in here[first + a].as_py():
                        us.append(max(rid[first + a], rid[first + b]))
                        vs.append(min(rid[first + a], rid[first + b]))
        first = end
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _signed(texts: DataFrame) -> DataFrame:
    """``(rid, n_words, signature)`` of ``(rid, text)``."""

    def sign(batches):
        known = _Hashes()
        for batch in batches:
            words = [known.of(text) for text in batch.column("text").to_pylist()]
            sizes, signatures = pa.array([len(w) for w in words], pa.int32()), pa.array(map(signature_of, words), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), sizes, signatures], names=["rid", "n_words", "signature"])

    return texts.select("rid", "text").mapInArrow(sign, "rid bigint, n_words int, signature binary")


def _text_store(docs: DataFrame, text_col: str, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(rid, text)`` of the texts in ``pairs``."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()
    keys = materialize(texts.join(wanted, "rid").select("key", "rid"), "near-wanted")
    rows = docs.select(text_of(text_col).alias("text")).select(_digest("text").alias("key"), "text")
    # The same join for every size, so that what is shuffled grows with the input alone.
    found = rows.join(keys.hint("merge"), "key").groupBy("rid").agg(F.first("text").alias("text"))
    return materialize(found, "near-store")


def class_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, class_id)`` of every document."""
    members, classes = near_classes(docs, id_col, text_col, **options)
    return members.join(classes, "key").select("doc_id", F.col("class").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs``, with all columns, for each class: that of the least id."""
    _, classes = near_classes(docs, id_col, text_col, **options)
    chosen = classes.where("best").select("key", F.col("first_id").alias("id"))
    rows = packed(docs, key=F.unhex(F.md5(text_of(text_col).cast("binary"))), id=F.col(id_col))
    same = F.col("rows.key") == F.col("chosen.key")
    kept = rows.alias("rows").join(chosen.alias("chosen"), same & F.col("rows.id").eqNullSafe(F.col("chosen.id")))
    # Repeated rows have equal key and id: one of them stays.
    first = kept.groupBy("rows.key").agg(F.first("row").alias("row"))
    return first.select("row.*")
