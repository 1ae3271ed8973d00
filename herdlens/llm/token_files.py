"""Token ids as flat binary files with 64-bit document offsets.

A folder holds, for each part ``p`` of the range-sorted documents,

* ``tokens-p.bin``: the ids of its documents one after another, as unsigned
  little-endian integers of 2 or 4 bytes (2 if every id of the vocabulary fits),
* ``offsets-p.bin``: unsigned little-endian 64-bit integers, the global number
  of the first id of each document, and at the end that of the next part,
* ``index``: a Parquet table (part, place, doc_id) that maps documents to files,
* ``manifest``: a Parquet table with one row for each part: base of its ids and
  documents, their counts, and the bytes of an id.

Bases are prefix sums over the parts (one row each). Files are read by mapping
them into memory, or by ranges where the folder is not on a mounted disk.

Defined results: a null text counts as empty; every document ends with the end
id, so an empty one has exactly that id; documents are ordered by id (null
first), then by a digest of the text; repeated rows stay, each with its own
place; an empty table gives empty files and no rows; other columns are ignored.
A lost task writes its files again under another name and renames them, so
readers see whole files only.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdlens.llm.chunks import Memory, slices
from herdlens.llm.common import bounded_batches, text_of
from herdlens.session import new_path

REMEMBERED = 120 << 20  # bytes of words that a worker remembers
RUN = 1 << 12  # characters of words that are encoded as one text
SLICE = 12 << 20  # bytes of text that are encoded at once, one longer text aside
# Chunks of these characters are in composed form and have one lower-case form,
# so Arrow can cut them into the tokenizer's words before it sees them.
PLAIN = "^[\\x21-\\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"


class WordEncoder:
    """The tokenizers library behind a memory of words.

    The vocabulary's pattern never matches across white space, so the ids of a
    text are the ids of its space-separated chunks one after another.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.chunks, self.words = Memory(), Memory(REMEMBERED)  # chunks that are no plain words
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        letters = "a-z\xdf-\xf6\xf8-\xff"
        # The word pattern of the vocabulary, for lower-case text.
        self.pattern = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+"

    def _library(self, texts: list) -> list:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        coded = [np.array(e.ids, self.dtype).tobytes() for e in found]
        return [(c, len(c)) for c in coded]

    def _words_of(self, chunks: pa.Array) -> tuple:
        """Distinct words of some distinct chunks, the words of each chunk, and where those of each end.

        Words of plain chunks are cut by Arrow; any other chunk counts as a word of its own.
        """
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, "<|"))
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), self.pattern, r"\0 ")
        lists = pc.split_pattern(pc.utf8_rtrim(spaced, " "), " ")
        words, whole = lists.flatten().dictionary_encode(), chunks.filter(pc.invert(plain))
        mask = plain.to_numpy(zero_copy_only=False)
        sizes = np.ones(len(chunks), "int64")
        sizes[mask] = lists.value_lengths().to_numpy()
        index = np.empty(sizes.sum(), "int64")
        within = np.repeat(mask, sizes)
        index[within] = words.indices.to_numpy()
        index[~within] = len(words.dictionary) + np.arange(len(whole))
        return words.dictionary.to_pylist(), whole.to_pylist(), index, np.concatenate([[0], np.cumsum(sizes)])

    def _new_words(self, words: list) -> list:
        """Ids of words, many of them encoded as one text: the last token of a word says so."""
        out, size = [], self.dtype.itemsize
        for first, last in slices([len(w) + 1 for w in words], RUN):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words[first:last])], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == last - first:
                raw, at = ids.tobytes(), [0, *(ends * size).tolist()]
                out += [(raw[a:b], b - a) for a, b in zip(at, at[1:])]
            else:
                out += self._library(words[first:last])
        return out

    def encode(self, texts: pa.Array, end: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by the ids ``end``, and how many each has."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        words, whole, word_of, last = self._words_of(chunks.dictionary)
        coded = self.words(words, self._new_words) + self.chunks(whole, self._library)
        each = _lists([len(c) // self.dtype.itemsize for c in coded], np.frombuffer(b"".join(coded), self.dtype))
        running = np.concatenate([[0], np.cumsum(np.diff(each.offsets.to_numpy())[word_of])])
        # The end ids are one more chunk after those of each text.
        sizes_of = np.append(np.diff(running[last]), len(end))
        flat = np.concatenate([each.take(pa.array(word_of)).flatten().to_numpy(), np.array(end, self.dtype)])
        index, sizes = chunks.indices.to_numpy(), lists.value_lengths().to_numpy()
        index = np.insert(index, np.cumsum(sizes), len(sizes_of) - 1)
        ids = _lists(sizes_of, flat).take(pa.array(index)).flatten().to_numpy()
        running = np.concatenate([[0], np.cumsum(sizes_of[index])])
        return ids, np.diff(running[np.concatenate([[0], np.cumsum(sizes + 1)])])


def _lists(sizes, flat: np.ndarray) -> pa.ListArray:
    """Lists of some sizes of the values of ``flat``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32")), pa.array(flat))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, fill) -> None:
    """Write a file under a name of this attempt, then give it its real name."""
    system, root = _files(folder)
    system.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        fill(out)
    _settle(system, part, f"{root}/{name}")


def _settle(system, part: str, name: str) -> None:
    """Rename; a whole file of an earlier attempt has the same bytes and may stay."""
    try:
        system.move(part, name)
    except OSError:
        if not system.get_file_info(name).is_file:
            raise
        system.delete_file(part)


def _read(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory if it lies on a mounted disk."""
    from pyarrow import fs

    system, root = _files(folder)
    path = f"{root}/{name}"
    if not system.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 1, id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode ``docs`` in ascending ``id_col`` order into files; the folder's path."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = (folder or new_path(spark, "tokens")).rstrip("/")
    folder = folder if "://" in folder else f"file://{folder}"

    def encode(batches):
        encoder = word_encoder(tokenizer)
        part, place, counts = TaskContext.get().partitionId(), 0, []
        end = [] if end_id is None else [end_id]
        system, root = _files(folder)
        system.create_dir(root, recursive=True)
        own = f"{root}/.tokens-{part}-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text")
                for first, last in slices(pc.binary_length(texts).to_pylist(), SLICE):
                    coded, n = encoder.encode(texts.slice(first, last - first), end)
                    out.write(coded.tobytes())
                    counts.append(n)
                    k = last - first
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(k, part, "int32")), pa.array(np.arange(place, place + k, dtype="int64")),
                            ids.slice(first, k), pa.array(n), pa.array(np.full(k, encoder.dtype.itemsize, "int32")),
                        ],
                        names=["part", "place", "doc_id", "n_tokens", "width"],
                    )
                    place += k
        _settle(system, own, f"{root}/tokens-{part}.bin")
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, "int64"), *counts]))])
        _put(folder, f"local-{part}.bin", lambda out: out.write(starts.astype("<u8").tobytes()))

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    rows = ordered.mapInArrow(encode, f"part int, place bigint, doc_id {kind}, n_tokens bigint, width int")
    rows.write.parquet(f"{folder}/index")

    index = spark.read.parquet(f"{folder}/index")
    sizes = index.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("width").alias("width")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    zero = F.lit(0).cast("bigint")
    manifest = sizes.withColumns(
        {
            "base_docs": F.coalesce(F.sum("n_docs").over(before), zero),
            "base_tokens": F.coalesce(F.sum("n_tokens").over(before), zero),
        }
    )

    def place_offsets(batches):
        for batch in batches:
            for row in batch.to_pylist():
                local = _read(folder, f"local-{row['part']}.bin", "<u8")
                shifted = (local + np.uint64(row["base_tokens"])).astype("<u8").tobytes()
                _put(folder, f"offsets-{row['part']}.bin", lambda out, b=shifted: out.write(b))
            yield batch

    names = "part int, n_docs bigint, n_tokens bigint, width int, base_docs bigint, base_tokens bigint"
    spread = manifest.repartition(max(1, sizes.count()), "part")
    spread.mapInArrow(place_offsets, names).write.parquet(f"{folder}/manifest")
    return folder


def read_token_files(spark, folder: str, derive=None, schema: str = "ids array<bigint>") -> DataFrame:
    """``(doc_id, start, n_tokens, ...)`` of every document, from the files.

    ``derive`` maps the mapped ids of one document to further columns named by
    ``schema``; by default the ids themselves.
    """
    derive = derive or (lambda ids: (ids.tolist(),))
    fields = spark.createDataFrame([], schema).schema

    def open_parts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _read(folder, f"tokens-{row['part']}.bin", f"<u{row['width']}")
                offsets = _read(folder, f"offsets-{row['part']}.bin", "<u8").astype("int64")
                base = row["base_tokens"]
                for first in range(0, row["n_docs"], 1024):
                    last = min(first + 1024, row["n_docs"])
                    more = [derive(tokens[offsets[i] - base : offsets[i + 1] - base]) for i in range(first, last)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(last - first, row["part"], "int32")),
                            pa.array(np.arange(first, last, dtype="int64")), pa.array(offsets[first:last]),
                            pa.array(np.diff(offsets[first : last + 1])),
                            *[pa.array(list(c), arrow[i]) for i, c in enumerate(zip(*more, strict=True))],
                        ],
                        names=["part", "place", "start", "n_tokens", *fields.names],
                    )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in fields]
    parts = spark.read.parquet(f"{folder}/manifest")
    manifest = parts.repartition(max(1, parts.count()), "part")  # a given number is not put together again
    read = manifest.mapInArrow(open_parts, f"part int, place bigint, start bigint, n_tokens bigint, {schema}")
    index = spark.read.parquet(f"{folder}/index").select("part", "place", "doc_id")
    # The manifest's size says nothing about that of the ids: never broadcast them.
    return read.join(index.hint("merge"), ["part", "place"]).select("doc_id", "start", "n_tokens", *fields.names)
