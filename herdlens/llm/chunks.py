"""Texts as sequences of chunks that tokenizers treat one by one.

A chunk starts at a space or line end that follows a character which is not white
space. Word patterns of byte-level vocabularies never reach from such a character
into white space, and piece vocabularies without pieces that hold an inner space or
a line end never merge there, so the ids of a text are the ids of its chunks one
after another. A batch of texts is cut with Arrow and each distinct chunk handled once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space other than space, tab and line ends that some library counts as such.
RARE = "".join(c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \t\n\f\r")
# Texts that are not simply words with one space or line end between them.
ODD = rf"\s\s|^\s|\s$|[{RARE}]"
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


class Chunked(NamedTuple):
    """Distinct chunks of some rows, each with its white space in front."""

    rows: np.ndarray
    chunks: list
    index: np.ndarray  # chunk after chunk
    ends: np.ndarray  # of each row in ``index``, after a 0

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Sum over the chunks of each row of a whole number that each distinct chunk has."""
        running = np.concatenate([[0], np.cumsum(each[self.index])])
        return running[self.ends[1:]] - running[self.ends[:-1]]

    def joined(self, texts: pa.Array, separator: str, most: int = 1 << 17) -> Iterator[str]:
        """Text of each row: the texts of its chunks with the separator between them.

        ``texts`` has one for each distinct chunk; rows of ``most`` chunks are put together at once.
        """
        for start, end in slices(np.diff(self.ends).tolist(), most):
            first, last = self.ends[start], self.ends[end]
            parts = texts.take(pa.array(self.index[first:last]))
            ends = pa.array((self.ends[start : end + 1] - first).astype("int32"))
            yield from pc.binary_join(pa.ListArray.from_arrays(ends, parts), separator).to_pylist()


def chunked(texts: pa.Array) -> Iterator[Chunked]:
    """Cut a space and each text (none null, none empty) into chunks."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd)
    if len(plain):
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = [c if c[:1] == "\n" else f" {c}" for c in coded.dictionary.to_pylist()]
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        yield Chunked(plain, chunks, coded.indices.to_numpy(), ends.astype("int64"))
    rest = np.flatnonzero(odd)
    if len(rest):
        places: dict = {}
        index, ends = [], [0]
        for text in texts.take(pa.array(rest)).to_pylist():
            index += [places.setdefault(c, len(places)) for c in BOUNDARY.split(f" {text}")]
            ends.append(len(index))
        yield Chunked(rest, list(places), np.array(index, "int64"), np.array(ends, "int64"))


class Memory:
    """What was worked out for short chunks, up to a number of bytes."""

    def __init__(self, most: int = 24 << 20, longest: int = 32):
        self.kept: dict = {}
        self.most, self.longest = most, longest

    def __call__(self, chunks: list, make) -> list:
        """The value of each of some distinct chunks; ``make`` gives those of a list of new ones, with their bytes."""
        out = list(map(self.kept.get, chunks))
        new = [i for i, value in enumerate(out) if value is None]
        for i, (value, size) in zip(new, make([chunks[i] for i in new]), strict=True):
            chunk = chunks[i]
            out[i] = value
            if self.most > 0 and len(chunk) <= self.longest:
                self.kept[chunk] = value
                self.most -= size + 2 * len(chunk) + 200
        return out


def slices(sizes, most: int):
    """Ranges of rows whose sizes add up to about ``most``."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)
