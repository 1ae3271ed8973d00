"""Alignment of two tokenizers and how often their tokens meet in a corpus.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B).
Offsets where a token of both ends cut the tokens into groups; two tokens are linked
if their byte ranges overlap. How often a pair of ids is linked is counted over the
whole corpus, and every document gets sums over its links.

The first pass aligns blocks of documents and writes each block's distinct pairs with
their counts, beside its texts. A minimal perfect hash over all distinct pairs, in
shards of bounded size, gives each pair an index. Counts of groups of blocks are
dense vectors by that index, which are summed in a tree; an index counts for a pair
only if the pair stored there is the same. The second pass looks the counts of each
block's pairs up by index, aligns the documents of the block once more and sums.

Both libraries work on chunks (see ``chunks``): a distinct chunk is aligned once for
each block and pass, all of them together as columns of numbers. Workers remember the
tokens of short chunks, up to a number of bytes, for the blocks that follow.

Defined results: texts that are null or empty, and texts whose tokens of A or B do
not have the bytes of a space and the text, have no tokens: zeros and an empty
digest. Repeated rows stay, and count as often as they occur. Texts may have any
length; a block holds ``BLOCK`` characters, one longer text aside. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm.chunks import Chunked, Memory, chunked, slices
from herdlens.llm.common import bounded_batches, text_of
from herdlens.llm.perfect_hash import PerfectHash
from herdlens.session import materialize

BLOCK = 4 << 20  # characters of a block of documents
SHARD = 1 << 15  # pairs of a shard on average
PART = 1 << 18  # rows of a group of blocks and a shard on average
RUN = 1 << 14  # characters of chunks that are encoded as one text
REMEMBERED = 112 << 20  # bytes of chunks that a worker remembers with their tokens
FAN = 16  # vectors that a step of the tree adds up
HIGH = 32  # bits that the second id of a pair takes
NOTHING = np.empty(0, "int64")


def _byte_letters() -> dict:
    """The letter that a byte-level vocabulary writes for each byte, by its rule: bytes
    with a visible Latin-1 letter keep it, the others take those from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligned(NamedTuple):
    """Tokens and links of chunks, one chunk after another in the order ``chunks``."""

    chunks: np.ndarray  # numbers of the chunks
    whole: np.ndarray  # whether the tokens have the bytes of the chunk, by number
    first: np.ndarray  # ids of A
    first_at: np.ndarray  # place of their chunk in ``chunks``
    first_group: np.ndarray
    second: np.ndarray
    second_at: np.ndarray
    second_group: np.ndarray
    links: np.ndarray
    link_at: np.ndarray

    def per_chunk(self, at: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Sums by chunk number of whole numbers given for tokens or links; how many if none are given."""
        ends = np.searchsorted(at, np.arange(len(self.chunks) + 1))
        running = np.arange(len(at) + 1) if values is None else np.concatenate([[0], np.cumsum(values)])
        out = np.zeros(len(self.whole), "int64")
        out[self.chunks] = running[ends[1:]] - running[ends[:-1]]
        return out

    def groups(self) -> np.ndarray:
        ends = np.flatnonzero(np.diff(self.first_group, append=-1))
        return self.per_chunk(self.first_at[ends])

    def texts(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each chunk, by number."""
        ids = np.concatenate([self.first, self.second])
        at = np.concatenate([self.first_at, self.second_at])
        group = np.concatenate([self.first_group, self.second_group])
        side = np.repeat([0, 1], [len(self.first), len(self.second)])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        ids, at, group, side = ids[order], at[order], group[order], side[order]
        same_group, same_side = group[:-1] == group[1:], side[:-1] == side[1:]
        after = np.where(same_group, np.where(same_side, 0, 1), np.where(at[:-1] == at[1:], 2, 3))
        after = np.concatenate([after, [3]])[: len(ids)]
        parts = _numbers(int(ids.max(initial=0)) + 1).take(pa.array(ids * 4 + after))
        ends = np.searchsorted(at, np.arange(len(self.chunks) + 1)).astype("int32")
        made = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), parts), "")
        place = np.full(len(self.whole), -1)
        place[self.chunks] = np.arange(len(self.chunks))
        return made.take(pa.array(place, mask=place < 0))


@lru_cache(maxsize=2)
def _numbers(n: int) -> pa.Array:
    """Every number below ``n`` with each of the four things that may follow it."""
    return pa.array([f"{i}{sign}" for i in range(n) for sign in (",", "|", ";", "")], pa.string())


class Aligner:
    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        letters = _byte_letters()
        tokens = {i: t for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        self.first_bytes = [
            bytes(letters[c] for c in t) if (t := tokens.get(i, "")) and all(c in letters for c in t) else t.encode()
            for i in range(max(tokens) + 1)
        ]
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        lib, size = self.second, self.second.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces with inner spaces or line ends cannot be cut into chunks")
        self.second_bytes = [
            bytes([int(p[1:-1], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.space = lib.piece_to_id("▁")
        self.first_sizes, self.second_sizes = (
            np.array([len(b) for b in x], "int64") for x in (self.first_bytes, self.second_bytes)
        )
        self.known = Memory(REMEMBERED)

    def _second_ids(self, texts: list) -> list:
        """Ids of texts that begin with a space, which the library adds, or with a line
        end, before which it adds one too many."""
        found = self.second.encode([t if t[0] == "\n" else t[1:] for t in texts], num_threads=1)
        return [
            [self.space] if t == " " else ids[1:] if t[0] == "\n" and ids[:1] == [self.space] else ids
            for t, ids in zip(texts, found, strict=True)
        ]

    def _tokens(self, runs: list, chunks: list) -> tuple:
        """Ids of runs of chunks, and which runs have tokens with the bytes of their text.

        A few runs at a time, as what the libraries return is many times larger than the ids.
        """
        firsts, seconds, good = [], [], []
        for some in range(0, len(runs), 8):
            texts = ["".join([chunks[i] for i in run]) for run in runs[some : some + 8]]
            found = zip(self.first.encode_batch_fast(texts, add_special_tokens=False), self._second_ids(texts), texts, strict=True)
            for encoded, b, text in found:
                a, raw = encoded.ids, text.encode()
                good.append(
                    b"".join([self.first_bytes[i] for i in a]) == raw and b"".join([self.second_bytes[i] for i in b]) == raw
                )
                firsts.append(np.array(a, "int32"))
                seconds.append(np.array(b, "int32"))
        return firsts, seconds, good

    def _cut(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list | None:
        """Ids up to each end of a chunk, as bytes; None if a token reaches over one."""
        at = np.cumsum(sizes[ids])
        cuts = np.searchsorted(at, ends)
        if (at[cuts] != ends).any():
            return None
        raw, cuts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def _new(self, chunks: list) -> list:
        """Ids of A and of B of chunks, nothing for those whose tokens have other bytes.

        Chunks that end in no white space are chunks of a text made of them as well, and so
        are encoded many at once; those of a text whose tokens have other bytes are tried
        one by one.
        """
        out: list = [((), 0)] * len(chunks)
        size = pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy()
        joined, rest = [], []
        for i, c in enumerate(chunks):
            (rest if c[-1].isspace() else joined).append(i)
        runs = [joined[a:b] for a, b in slices([len(chunks[i]) for i in joined], RUN)]
        for several in (True, False):
            alone = []
            for run, a, b, good in zip(runs, *self._tokens(runs, chunks), strict=True):
                found = None
                if good:
                    ends = np.cumsum(size[run])
                    found = self._cut(a, self.first_sizes, ends), self._cut(b, self.second_sizes, ends)
                if found and None not in found:
                    for i, x, y in zip(run, *found, strict=True):
                        out[i] = (x, y), len(x) + len(y) + 120
                elif several:
                    alone += [[i] for i in run]
            runs = alone + [[i] for i in rest]
        return out

    def __call__(self, chunks: list) -> Aligned:
        """Align each chunk."""
        found = self.known(chunks, self._new)
        order = [i for i, ids in enumerate(found) if ids]
        raw = [[found[i][side] for i in order] for side in (0, 1)]
        a, b = (np.frombuffer(b"".join(x), "int32").astype("int64") for x in raw)
        n_a, n_b = (np.array(list(map(len, x)), "int64") // 4 for x in raw)
        # Everything that was kept is one long text now, cut by chunk and by token ends.
        ends_a, ends_b = np.cumsum(self.first_sizes[a]), np.cumsum(self.second_sizes[b])
        ends = ends_a[np.cumsum(n_a) - 1]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last = np.union1d(ends_a, ends_b)  # where a link ends, one of its tokens does
        links = a[np.searchsorted(ends_a, last)] << HIGH | b[np.searchsorted(ends_b, last)]
        whole = np.zeros(len(chunks), bool)
        whole[order] = True
        return Aligned(
            np.array(order, "int64"), whole,
            a, np.repeat(np.arange(len(order)), n_a), np.searchsorted(common, ends_a),
            b, np.repeat(np.arange(len(order)), n_b), np.searchsorted(common, ends_b),
            links, np.searchsorted(ends, last),
        )


@lru_cache(maxsize=2)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def _whole_texts(cut: Chunked, done: Aligned) -> np.ndarray:
    return cut.sums((~done.whole).astype("int64")) == 0


def _pair_counts(cut: Chunked, done: Aligned) -> tuple:
    """Distinct pairs of the texts that have tokens, and their links."""
    used = np.repeat(_whole_texts(cut, done), np.diff(cut.ends))
    times = np.bincount(cut.index[used], minlength=len(done.whole))
    pairs, at = np.unique(done.links, return_inverse=True)
    counts = np.bincount(at, times[done.chunks[done.link_at]], minlength=len(pairs)).astype("int64")
    return pairs[counts > 0], counts[counts > 0]


def _pairs_of(texts: pa.Array, align: Aligner) -> tuple:
    """Distinct pairs of some texts, and their links."""
    parts = [_pair_counts(cut, align(cut.chunks)) for cut in chunked(texts)]
    pairs, at = np.unique(np.concatenate([NOTHING, *[p for p, _ in parts]]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([NOTHING, *[n for _, n in parts]]), minlength=len(pairs))
    return pairs, counts.astype("int64")


def _first_pass(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of documents ``(block, doc_id, text)`` and of pairs ``(block, pair, n)`` in one table."""

    def work(batches):
        align, part, number = aligner(first, second), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def block():
            whole, whole_ids = pa.concat_arrays(texts), pa.concat_arrays(ids)
            told = pa.array(np.full(len(whole), (part << 32) + number, "int64"))
            none = pa.nulls(len(whole), pa.int64())
            yield pa.RecordBatch.from_arrays([told, whole_ids, whole, none, none], names=names)
            filled = whole.filter(pc.greater(pc.binary_length(whole), 0))
            pairs, counts = _pairs_of(filled, align) if len(filled) else (NOTHING, NOTHING)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, (part << 32) + number, "int64")), pa.nulls(n, whole_ids.type),
                    pa.nulls(n, whole.type), pa.array(pairs), pa.array(counts),
                ],
                names=names,
            )

        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_pylist()
            for start, end in slices(lengths, BLOCK):
                ids.append(batch.column("doc_id").slice(start, end - start))
                texts.append(batch.column("text").slice(start, end - start))
                size += sum(lengths[start:end])
                if size >= BLOCK:
                    yield from block()
                    ids, texts, size, number = [], [], 0, number + 1
        if texts:
            yield from block()

    names = ["block", "doc_id", "text", "pair", "n"]
    kinds = [T.LongType(), docs.schema["doc_id"].dataType, T.StringType(), T.LongType(), T.LongType()]
    return docs.mapInArrow(work, T.StructType([T.StructField(*f) for f in zip(names, kinds, strict=True)]))


def _hashes(pairs: DataFrame) -> DataFrame:
    """``(shard, sizes, bits, keys)``: a perfect hash of the pairs of each shard, keys by index."""

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("pair").to_numpy()
        made = PerfectHash.build(keys)
        stored = np.empty(len(keys), "int64")
        stored[made.index(keys)] = keys
        return pa.table({
            "shard": table.column("shard")[:1], "sizes": pa.array([made.sizes], pa.list_(pa.int32())),
            "bits": pa.array([made.bits], pa.binary()), "keys": pa.array([stored.tobytes()], pa.binary()),
        })

    return pairs.groupBy("shard").applyInArrow(build, "shard int, sizes array<int>, bits binary, keys binary")


def _placed(hashes: pa.Table, pairs: np.ndarray) -> np.ndarray:
    """Index of each pair in the dense vectors of its shard; a pair must be the one stored there."""
    row = hashes.to_pylist()[0]
    index = PerfectHash(row["sizes"], row["bits"]).index(pairs)
    if not (np.frombuffer(row["keys"], "<i8")[index] == pairs).all():
        raise ValueError("a pair is missing from the perfect hash")
    return index


def pair_counts(parts: DataFrame, shards: int, groups: int) -> DataFrame:
    """``(shard, sizes, bits, keys, counts)`` from ``(block, shard, part, pair, n)``.

    ``counts`` is the dense vector of the shard: links of each pair in all blocks.
    """
    pairs = parts.select("shard", "pair").distinct()
    hashes = materialize(_hashes(pairs), "pair-hashes")

    def dense(rows: pa.Table, hashed: pa.Table) -> pa.Table:
        index = _placed(hashed, rows.column("pair").to_numpy())
        vector = np.zeros(len(hashed.column("keys")[0].as_py()) // 8, "int64")
        np.add.at(vector, index, rows.column("n").to_numpy())
        told = pa.table({"shard": rows.column("shard")[:1], "part": rows.column("part")[:1]})  # none for a part without pairs
        return told.append_column("counts", pa.array([vector.tobytes()][: told.num_rows], pa.binary()))

    def added(table: pa.Table) -> pa.Table:
        vector = sum(np.frombuffer(b, "<i8") for b in table.column("counts").to_pylist())
        return table.slice(0, 1).set_column(2, "counts", pa.array([vector.tobytes()], pa.binary()))

    schema = "shard int, part int, counts binary"
    sums = _with_hashes(parts.select("shard", "part", "pair", "n"), hashes, groups).applyInArrow(dense, schema)
    while groups > 1:
        groups = math.ceil(groups / FAN)
        upper = sums.select("shard", F.floor(F.col("part") / FAN).cast("int").alias("part"), "counts")
        sums = upper.groupBy("shard", "part").applyInArrow(added, schema)
    return materialize(hashes.join(sums.select("shard", "counts"), "shard"), "pair-counts")


def _with_hashes(rows: DataFrame, hashes: DataFrame, groups: int):
    """Rows by shard and part, each with the shard's hash."""
    copies = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))


def _best(counts: DataFrame) -> np.ndarray:
    """The highest count of each second id; as long as its vocabulary at most."""

    def highest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["keys"], "<i8") & ((1 << HIGH) - 1)
                best = np.zeros(int(ids.max()) + 1, "int64")
                np.maximum.at(best, ids, np.frombuffer(row["counts"], "<i8"))
                at = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype("int64")), pa.array(best[at])], names=["id", "best"])

    each = counts.select("keys", "counts").mapInArrow(highest, "id bigint, best bigint")
    rows = each.groupBy("id").agg(F.max("best").alias("best")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, "int64")
    for r in rows:
        out[r["id"]] = r["best"]
    return out


def aligned(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each document.

    ``first`` and ``second`` are the files of the byte-level and the piece vocabulary.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    passed = materialize(_first_pass(source, first, second), "alignment-blocks")
    pairs = passed.where(F.col("pair").isNotNull()).select("block", "pair", "n")
    told = pairs.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("pair").alias("pairs")).first()
    shards = max(1, math.ceil(told["pairs"] / SHARD))
    groups = max(1, math.ceil(told["rows"] / shards / PART))
    parts = pairs.withColumns({
        "shard": F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("int"),
        "part": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"),
    })
    counts = pair_counts(parts, shards, groups)
    best = _best(counts)

    def looked_up(rows: pa.Table, table: pa.Table) -> pa.Table:
        index = _placed(table, rows.column("pair").to_numpy())
        found = np.frombuffer(table.column("counts")[0].as_py(), "<i8")[index]
        return pa.table({"block": rows.column("block"), "pair": rows.column("pair"), "count": pa.array(found)})

    found = _with_hashes(parts.select("shard", "part", "block", "pair"), counts, groups).applyInArrow(
        looked_up, "block bigint, pair bigint, count bigint"
    )
    texts = passed.where(F.col("pair").isNull()).select("block", "doc_id", "text")

    def again(rows: pa.Table, known: pa.Table) -> pa.Table:
        align = aligner(first, second)
        known = known.sort_by("pair")
        pairs, counted = known.column("pair").to_numpy(), known.column("count").to_numpy()
        top = counted == best[pairs & ((1 << HIGH) - 1)]
        rows = rows.combine_chunks()
        text, n = rows.column("text").combine_chunks(), rows.num_rows
        out = np.zeros((6, n), "int64")
        digests = [""] * n
        filled = np.flatnonzero(pc.binary_length(text).to_numpy(zero_copy_only=False))
        for cut in chunked(text.take(pa.array(filled))) if len(filled) else ():
            done = align(cut.chunks)
            whole = _whole_texts(cut, done)
            where = np.searchsorted(pairs, done.links)
            where[where == len(pairs)] = 0
            sure = pairs[where] == done.links if len(pairs) else np.zeros(len(done.links), bool)
            number = np.where(sure, counted[where], 0) if len(pairs) else np.zeros(len(done.links), "int64")
            is_best = sure & top[where] if len(pairs) else sure
            each = [done.per_chunk(done.first_at), done.per_chunk(done.second_at), done.groups(), done.per_chunk(done.link_at)]
            each += [done.per_chunk(done.link_at, x) for x in (is_best, number)]
            places = filled[cut.rows]
            for line, values in enumerate(each):
                out[line, places] = np.where(whole, cut.sums(values), 0)
            for place, sound, line in zip(places, whole, cut.joined(done.texts(), ";"), strict=True):
                if sound:
                    digests[place] = hashlib.sha256(line.encode()).hexdigest()
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        return pa.table({"doc_id": rows.column("doc_id"), **dict(zip(names, map(pa.array, out), strict=True)), "groups_sha256": pa.array(digests, pa.string())})

    kind = source.schema["doc_id"].dataType
    numbers = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    schema = T.StructType([T.StructField("doc_id", kind), *numbers, T.StructField("groups_sha256", T.StringType())])
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(again, schema)
