"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one for each character, with ``▁`` for a space and
one in front. An agenda holds the adjacent pairs of symbols that form a piece of
the vocabulary, best score first and the leftmost of equals; merging a pair
replaces it and puts its new neighbours on the agenda. Characters without a
piece become their UTF-8 bytes.

Two facts keep this fast without changing any id. A merge can only cross two
characters that stand side by side in some piece of the vocabulary, so a text
can be cut everywhere else (before every space run and line end above all, which
Arrow does for a batch at once). And equal cuts have equal ids, so each distinct one
of a batch is encoded once, and short ones are remembered by a worker up to a number
of bytes. Every cut that is not remembered is also encoded by the library, many in
one call, and a difference ends the task with an error. Decoding is the library's.

Defined results: null counts as empty; an empty text has no ids and decodes to
the empty text; texts of any length are cut and never shortened; repeated rows
repeat; an empty table gives an empty table; columns other than the text pass
through as named by ``keep``, and one named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm.chunks import Chunked, Memory, chunked, slices
from herdlens.llm.common import bounded_batches, text_of

RUN = 1 << 14  # characters of cuts that the library encodes as one text
LONG = 64  # characters of a cut from which it has an agenda of its own
REMEMBERED = 72 << 20  # bytes of cuts that a worker remembers
SLICE = 12 << 20  # bytes of text that are cut at once, one longer text aside
SPACE = "▁"


class PieceModel:
    def __init__(self, path: str, verify: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.verify = verify
        lib, size = self.library, self.library.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i) for i in range(size)]
        self.ids = {lib.id_to_piece(i): i for i in range(size) if not special[i]}
        self.costs = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if not self.bytes or any(SPACE in p[1:] and p[0] != SPACE or "\n" in p for p in self.pairs):
            raise ValueError("a merge-type vocabulary with byte fallback and word-initial spaces is needed")
        self._tables(self.ids)
        self.chunks, self.parts = Memory(REMEMBERED), Memory(REMEMBERED)

    def merge(self, text: str) -> bytes:
        """Ids of a text whose spaces are ``▁`` already: the agenda itself."""
        symbols, costs, n = list(text), self.costs, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in costs:
                agenda.append((costs[piece], i, i + 1, piece))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or symbols[i] + symbols[j] != piece:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = piece, None
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                more = piece + symbols[k]
                if more in costs:
                    heapq.heappush(agenda, (costs[more], i, k, more))
            if p >= 0:
                more = symbols[p] + piece
                if more in costs:
                    heapq.heappush(agenda, (costs[more], p, i, more))
        found = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                found += [self.bytes[b] for b in s.encode("utf-8")] if i is None else [i]
        return np.array(found, "<i4").tobytes()

    def _cut(self, chunk: str) -> list:
        """Parts of a chunk that no merge connects; whole words stay whole at once."""
        text, pairs = SPACE + chunk.replace(" ", SPACE), self.pairs
        if chunk.isalpha():
            return [text]
        if chunk[:-1].isalpha() and chunk[-2:] not in pairs:
            return [text[:-1], text[-1]]
        cuts, first = [], 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in pairs:
                cuts.append(text[first:k])
                first = k
        cuts.append(text[first:])
        return cuts

    def _tables(self, pieces: dict) -> None:
        """Numbers for all symbols, and which two of them merge into which, by what costs.

        A symbol is a piece or a single character of one; the number of a piece is its id.
        """
        number = dict(pieces)
        for c in set().union(*pieces):
            number.setdefault(c, max(len(number), max(pieces.values()) + 1) + len(number))
        merges = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = (i, self.costs[piece])
        self.merge_keys = np.array(sorted(merges), "int64")
        self.merge_ids = np.array([merges[k][0] for k in self.merge_keys.tolist()], "int64")
        self.merge_costs = np.array([merges[k][1] for k in self.merge_keys.tolist()], "f8")
        self.of_character = np.full(0x110000, -1, "int64")
        for symbol, i in number.items():
            if len(symbol) == 1:
                self.of_character[ord(symbol)] = i
        self.most_id = max(pieces.values())
        self.numbers = pa.array(list(map(str, range(self.library.get_piece_size()))), pa.string())

    def merge_many(self, texts: list) -> list:
        """:meth:`merge` for many texts at once: each round every text takes the first pair
        of its own agenda, the cheapest one and of equals the leftmost."""
        lengths = np.array([len(t) for t in texts], "int64")
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        symbols, word = self.of_character[points], np.repeat(np.arange(len(texts)), lengths)
        alone = lengths > LONG  # many rounds for few texts; these keep an agenda of their own
        alone[word[symbols < 0]] = True
        active = ~alone[word]
        symbols, word = symbols[active], word[active]
        done = []
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            pair = np.flatnonzero((self.merge_keys[at] == key) & (word[:-1] == word[1:]))
            at = at[pair]
            order = np.lexsort((pair, self.merge_costs[at], word[pair]))
            owner = word[pair[order]]
            first = order[np.concatenate([[True], owner[1:] != owner[:-1]])[: len(order)]]
            symbols[pair[first]] = self.merge_ids[at[first]]
            moving = np.zeros(len(texts), bool)
            moving[owner] = True
            rest = ~moving[word]
            done.append((word[rest], symbols[rest]))
            kept = moving[word]
            kept[pair[first] + 1] = False
            symbols, word = symbols[kept], word[kept]
        if done:
            word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([x for _, x in done])
            alone[word[symbols > self.most_id]] = True  # a character that is no piece becomes bytes
            order = np.argsort(word, kind="stable")
            raw = symbols[order].astype("<i4").tobytes()
            ends = 4 * np.searchsorted(word[order], np.arange(len(texts) + 1))
        return [
            self.merge(t) if own else raw[start:end]
            for t, own, start, end in zip(
                texts, alone.tolist(), *((ends[:-1].tolist(), ends[1:].tolist()) if done else ([0] * len(texts), [0] * len(texts))),
                strict=True,
            )
        ]

    def _new(self, chunks: list) -> list:
        """Ids of chunks, each of which begins with a space or a line end."""
        # As after a space, which is a part of its own before a line end.
        cuts = [self._cut(c)[1:] if c[0] == "\n" else self._cut(c[1:]) for c in chunks]
        parts = list(set().union(*cuts)) if cuts else []
        known = dict(zip(parts, self.parts(parts, lambda new: [(x, len(x)) for x in self.merge_many(new)]), strict=True))
        found = [known[c[0]] if len(c) == 1 else b"".join([known[x] for x in c]) for c in cuts]
        if self.verify:
            self._compare(chunks, found)
        return [(x, len(x)) for x in found]

    def _compare(self, chunks: list, found: list) -> None:
        """The library's ids of the same chunks, most of them put together to longer texts."""
        inner = [i for i, c in enumerate(chunks) if c[-1] != " "]
        runs = [inner[a:b] for a, b in slices([len(chunks[i]) for i in inner], RUN)]
        runs += [[i] for i, c in enumerate(chunks) if c[-1] == " "]  # may merge with a space that follows
        for run in runs:
            text = "".join([chunks[i] for i in run])
            ids = self.library.encode(text if text[0] == "\n" else text[1:], num_threads=1)
            if text[0] == "\n":  # the library's own space, which is a piece of its own there
                ids = ids[1:]
            elif text == " ":
                ids = [self.ids[SPACE]]
            if np.array(ids, "<i4").tobytes() != b"".join([found[i] for i in run]):
                raise ValueError(f"ids differ from the library's within {text[:2000]!r}")

    def encode_array(self, texts: pa.Array) -> Iterator[tuple]:
        """``(cut, coded)`` for texts that are not null and not empty: their chunks, and the
        ids of each distinct one as little-endian 32-bit integers in bytes."""
        texts = texts.cast(pa.large_string())
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")  # as the library reads it
        for cut in chunked(texts):
            yield cut, self.chunks(cut.chunks, self._new)

    def encode(self, texts: list) -> list:
        """Ids of each text, as little-endian 32-bit integers in bytes."""
        out = [b""] * len(texts)
        filled = [i for i, t in enumerate(texts) if t]
        for cut, coded in self.encode_array(pa.array([texts[i] for i in filled], pa.large_string())) if filled else ():
            for k, row in enumerate(cut.rows.tolist()):
                out[filled[row]] = b"".join([coded[i] for i in cut.index[cut.ends[k] : cut.ends[k + 1]].tolist()])
        return out

    def decode(self, ids: list) -> list:
        return self.library.decode(ids, num_threads=1)


@lru_cache(maxsize=2)
def piece_model(path: str, verify: bool = True) -> PieceModel:
    return PieceModel(path, verify)


def _ids_of(cut: Chunked, coded: list) -> pa.ListArray:
    """The ids of each text of ``cut``."""
    sizes = np.array([len(c) // 4 for c in coded], "int64")
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(coded), "<i4")))
    totals = np.concatenate([[0], np.cumsum(cut.sums(sizes))]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(totals), lists.take(pa.array(cut.index)).flatten())


def _coded(df: DataFrame, model: str, keep: list, text_col: str, verify: bool, more: list, work) -> DataFrame:
    """Columns ``keep`` and those that ``work(codec, cut, coded)`` gives for each part of a batch.

    ``work`` gets ``None, None`` for texts that are empty; then it gives the values of one.
    """
    bounded_batches(df.sparkSession)
    keep = [c for c in keep if c not in {f.name for f in more}]

    def encode(batches):
        codec = piece_model(model, verify)
        names = [*keep, *[f.name for f in more]]
        for batch in batches:
            lengths = pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
            for first, last in slices(lengths, SLICE):
                part = batch.slice(first, last - first)
                texts, size = part.column(part.num_columns - 1), np.array(lengths[first:last])
                empty, filled = np.flatnonzero(size == 0), np.flatnonzero(size)
                if len(empty):
                    values = [pa.array([v] * len(empty), k) for v, k in zip(work(codec, None, None), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(empty)) for c in part.columns[:-1]], *values], names=names)
                for cut, coded in codec.encode_array(texts.take(pa.array(filled))) if len(filled) else ():
                    kept = [c.take(pa.array(filled[cut.rows])) for c in part.columns[:-1]]
                    values = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(work(codec, cut, coded), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept, *values], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in more]
    schema = T.StructType([*[df.schema[c] for c in keep], *more])
    named = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]  # so that no name clashes with the text's
    return df.select(*named, text_of(text_col).alias("text")).mapInArrow(encode, schema)


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())


def encode_texts(df: DataFrame, model: str, keep: list, text_col: str = "text", verify: bool = True) -> DataFrame:
    """Columns ``keep`` of ``df`` and ``ids`` of its text, without begin or end ids."""
    return _coded(df, model, keep, text_col, verify, [IDS], lambda codec, cut, coded: [_ids_of(cut, coded) if cut else []])


def _decoded(codec: PieceModel, ids: pa.ListArray) -> list:
    """Texts of ids, a bounded number of ids at a time."""
    out, ends, flat = [], ids.offsets.to_pylist(), ids.values.to_numpy()
    for first, last in slices(np.diff(ends).tolist(), 1 << 18):
        base = ends[first]
        some = flat[base : ends[last]].tolist()
        out += codec.decode([some[ends[i] - base : ends[i + 1] - base] for i in range(first, last)])
    return out


def code_and_decode(df: DataFrame, model: str, keep: list, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df``, ``ids`` of its text and what the library decodes from them, in one pass."""

    def work(codec, cut, coded):
        if cut is None:
            return [[], ""]
        ids = _ids_of(cut, coded)
        return [ids, _decoded(codec, ids)]

    return _coded(df, model, keep, text_col, True, [IDS, DECODED], work)


def code_digests(df: DataFrame, model: str, keep: list, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df``, ``n_tokens``, and digests of the ids and of the decoded text, in one pass."""

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def work(codec, cut, coded):
        if cut is None:
            return [0, digest(""), digest("")]
        ids = _ids_of(cut, coded)
        ends = pa.array(np.cumsum([0, *[len(c) // 4 for c in coded]]).astype("int32"))
        numbers = codec.numbers.take(pa.array(np.frombuffer(b"".join(coded), "<i4")))
        listed = pc.binary_join(pa.ListArray.from_arrays(ends, numbers), ",")
        return [
            ids.value_lengths().cast(pa.int64()), list(map(digest, cut.joined(listed, ","))), list(map(digest, _decoded(codec, ids)))
        ]

    told = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _coded(df, model, keep, text_col, True, [T.StructField(*f) for f in told], work)


def decode_ids(df: DataFrame, model: str, keep: list, ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` of ``df`` and ``decoded``, the text of its ids (null ids: empty)."""
    bounded_batches(df.sparkSession)
    keep = [c for c in keep if c != DECODED.name]

    def decode(batches):
        codec = piece_model(model)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = lists.value_lengths().fill_null(0).to_pylist()
            for first, last in slices(sizes, 1 << 18):
                ids = [x or [] for x in lists.slice(first, last - first).to_pylist()]
                kept = [c.slice(first, last - first) for c in batch.columns[:-1]]
                decoded = pa.array(codec.decode(ids), pa.string())
                yield pa.RecordBatch.from_arrays([*kept, decoded], names=[*keep, DECODED.name])

    schema = T.StructType([*[df.schema[c] for c in keep], DECODED])
    named = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    return df.select(*named, F.col(ids_col).alias("ids")).mapInArrow(decode, schema)
