"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text: it depends on the last 16 bytes only,
and where its upper bits are zero the text may be cut. Inserting or deleting text
so moves no cut further on. A chunk goes from a cut to the first cut that is at
least ``LEAST`` bytes on, and there is one for every cut, so a passage that stands
in two texts has the same chunks in both, but for its edges. Chunks are
deduplicated by a 96-bit digest: all but the earliest of equal chunks are repeats.
Repeats that touch or overlap are one run, and runs of ``RUN`` bytes or more go.

Digests are counted before anything else, on bare numbers, and only the rows of
repeated digests are joined with their places. The lookups have one row for each
digest and are written first, so that adaptive execution can split a digest that
very many documents have.

Defined results: earlier means a smaller ``doc_id`` (null first), for equal ids a
smaller hash of the text, then further up; rows that agree in id and text are one
document; null counts as empty and stays null; texts of fewer than ``LEAST``
bytes have no chunks and never change; an empty table gives no rows. Places are
bytes of the UTF-8 text, never inside a character.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import bounded_batches, packed, text_of
from herdlens.session import materialize

LEAST = 64  # bytes of a chunk, at least
RUN = 100  # bytes of a run that goes, at least
ZEROS = 5  # upper bits of the hash that must be zero at a cut: one byte in 32


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A pseudo-random number for each byte."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:2], "big") for b in range(256)], np.uint16)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: h = 2 h + gear[byte], all at once by doubling the reach."""
    h = _gear()[data]
    for reach in (1, 2, 4, 8):
        if len(h) > reach:
            shifted = h[:-reach] << np.uint16(reach)
            h = h.copy()
            h[reach:] += shifted
    return h


def chunk_places(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, start and end of every chunk of ``texts`` (bytes)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    able = rolling_hash(data) >> np.uint16(16 - ZEROS) == 0
    able[:-1] &= data[1:] & 0xC0 != 0x80  # the next byte starts a character
    cuts = np.flatnonzero(able) + 1
    text = np.searchsorted(ends, cuts - 1, side="right")
    cuts = cuts[cuts - starts[text] >= 16]  # the hash has seen bytes of this text only
    # Both ends of a text are cuts as well.
    cuts = np.unique(np.concatenate([cuts, starts, ends]))
    following = np.searchsorted(cuts, cuts + LEAST)
    text = np.searchsorted(ends, cuts, side="right")
    inside = (following < len(cuts)) & (text < len(texts))
    text, first, last = text[inside], cuts[inside], cuts[following[inside]]
    whole = last <= ends[text]
    text, first, last = text[whole], first[whole], last[whole]
    return text, first - starts[text], last - starts[text]


def chunks(texts: DataFrame) -> DataFrame:
    """``(digest, check, doc_id, tie, start, end)`` of every chunk; ``texts`` has doc_id, tie, text."""
    bounded_batches(texts.sparkSession)

    def cut(batches):
        for batch in batches:
            data = batch.column("text").cast(pa.binary()).to_pylist()
            first = 0
            while first < len(data):
                last, size = first, 0
                while last < len(data) and (size == 0 or size + len(data[last]) <= 4 << 20):
                    size += len(data[last])
                    last += 1
                group = data[first:last]
                text, start, end = chunk_places(group)
                digest = xxhash.xxh3_128_digest
                named = b"".join([digest(group[t][a:b]) for t, a, b in zip(text.tolist(), start.tolist(), end.tolist(), strict=True)])
                words = np.frombuffer(named, "<i4").reshape(-1, 4)
                rows = pa.array(text + first)
                for a in range(0, len(text), 1 << 16):
                    b = min(a + (1 << 16), len(text))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.ascontiguousarray(words[a:b, :2]).view("<i8")[:, 0]), pa.array(words[a:b, 2]),
                            batch.column("doc_id").take(rows[a:b]), batch.column("tie").take(rows[a:b]),
                            pa.array(start[a:b].astype("int32")), pa.array(end[a:b].astype("int32")),
                        ],
                        names=["digest", "check", "doc_id", "tie", "start", "end"],
                    )
                first = last

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"digest bigint, check int, doc_id {kind}, tie bigint, start int, end int")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tie, start, end, source)`` of every chunk that stands earlier, at ``source``."""
    rows = chunks(_texts(docs, id_col, text_col))
    common = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    repeated = materialize(rows.join(materialize(common, "chunk-digests"), "digest", "left_semi"), "chunks")
    place = F.struct("doc_id", "tie", "start")
    earliest = repeated.groupBy("digest", "check").agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n"))
    sources = materialize(earliest.where("n > 1").drop("n"), "chunk-sources")
    return repeated.join(sources, ["digest", "check"]).where(place != F.col("source")).select(
        "doc_id", "tie", "start", "end", "source"
    )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``(doc_id, tie, runs)`` of the documents that repeat something.

    ``runs`` lists start, end, and the document that has the run's first chunk
    first, in the order of the text.
    """
    chunk = F.struct("start", "end", F.col("source.doc_id").alias("source_id"))
    each = repeated_chunks(docs, id_col, text_col).groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(chunk)).alias("c"))
    # A chunk ends at the first cut that is far enough on, so ends ascend with
    # starts, and a run ends where the next chunk starts behind this one's end.
    first = F.filter("c", lambda x, i: (i == 0) | (x["start"] > F.get("c", i - 1)["end"]))
    last = F.filter("c", lambda x, i: (i == F.size("c") - 1) | (F.get("c", i + 1)["start"] > x["end"]))
    zipped = F.arrays_zip(first.alias("a"), last.alias("b"))
    runs = F.transform(
        zipped, lambda z: F.struct(z["a"]["start"].alias("start"), z["b"]["end"].alias("end"), z["a"]["source_id"].alias("source_id"))
    )
    kept = F.filter(runs, lambda r: r["end"] - r["start"] >= run)
    return each.select("doc_id", "tie", kept.alias("runs")).where("size(runs) > 0")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``docs``, all rows and columns, with later repeats of passages cut out of the text."""
    runs = materialize(repeated_runs(docs, id_col, text_col, run), "chunk-runs")
    rows = packed(docs, id=F.col(id_col), tie=F.xxhash64(text_of(text_col)))
    found = runs.select(F.col("doc_id").alias("run_id"), F.col("tie").alias("run_tie"), "runs")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("tie") == F.col("run_tie")), "left")
    data = F.col(f"row.`{text_col}`").cast("binary")
    from_byte = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
    to_byte = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.octet_length(data)))
    pieces = F.transform(
        F.arrays_zip(from_byte.alias("a"), to_byte.alias("b")),
        lambda z: F.substring(data, z["a"] + 1, z["b"] - z["a"]).cast("string"),
    )
    text = F.when(F.col("runs").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(pieces, ""))
    return joined.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
