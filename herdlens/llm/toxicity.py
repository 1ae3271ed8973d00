"""Toxicity of texts that may be disguised: noisy-channel restoration, then a classifier.

1. A character language model: trigram counts of all documents, over ``SYMBOLS``
   classes of characters, so what it gathers is bounded by the alphabet while it
   reads every text.
2. Restoration: a token that may be disguised becomes a lattice. A digit or sign
   can stand for the letters that look like it, signs between letters can be noise
   or breaks, a letter repeated three times or more can stand for one or two, and
   letters written apart can be a word. The path of least cost (channel cost and
   language model) is found by the Viterbi algorithm over the last two letters.
   Other tokens have a single path and stay as they are.
3. Features of a text are its restored words and their first three, four and five
   letters. Those that labelled documents have far more often if toxic are
   counted and chosen by Spark, and a logistic regression weighs them. As toxic
   texts mostly have several of them, it makes little of one alone; so a score is
   never below the lower confidence bound of the toxic share among labelled texts
   with any one of the features.

Labels are learned from at most ``FIT_ROWS`` labelled documents (those of the
least hash), at most ``FEATURES`` features are weighed: with the language model
these are all that the driver holds or broadcasts, whatever the size of the
corpus. Counts of the language model cover all documents and every whole text is
scored.

Defined results: null counts as the empty text, whose score is that of a text
without features; labels of null are ignored and of several labels of a document
the highest counts; without any toxic label every score is the (smoothed) share
of toxic labels; repeated rows get equal scores; an empty table gives no rows. A
token longer than ``UNIT`` characters is restored in pieces.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm.common import bounded_batches, packed, text_of

FIT_ROWS = 20_000
FEATURES = 4_096
SYMBOLS = 64
UNIT = 256
KEPT = 300_000  # tokens whose features a worker remembers
THRESHOLD = 0.3
SURE = 0.9  # least share of toxic texts from which one feature decides alone

# Which letters a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Costs of the channel, as negative logarithms.
LOOKS_LIKE, NOISE, BREAK, SHRINK, MASKED = 1.5, 1.5, 1.0, 1.0, 3.0
EDGE = ".,;:?\"'()[]{}<>#&%*!-_~^/\\`"  # signs that do not belong to a word they stand at the end of
FRONT = EDGE.replace("(", "").replace("!", "")  # or at its start
TRIPLE = re.compile(r"(.)\1\1")
APART = re.compile(r"(?:(?<=\s)|^)\S(?:\s\S){2,}(?=\s|$)")


def _classes() -> np.ndarray:
    """A class for each code up to 255; others have that of unknown letters."""
    table = np.full(257, SYMBOLS - 1, np.int64)
    table[:128] = 0  # spaces, digits, signs: the edge of a word
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    for code in range(0xDF, 0x100):
        table[code] = len(LETTERS) + 1 + code - 0xDF
    table[0xF7] = 0
    return table


CLASSES = _classes()


def _class_of(c: str) -> int:
    return int(CLASSES[min(ord(c), 256)])


def trigram_counts(texts: DataFrame) -> DataFrame:
    """``(code, n)``: how often three character classes follow each other, over all texts."""
    bounded_batches(texts.sparkSession)

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
                classes = CLASSES[np.minimum(codes, 256)]
                classes = classes[np.concatenate([[True], (classes[1:] != 0) | (classes[:-1] != 0)])]  # one edge between words
                # A word starts after two edges, so that its first letters are counted as such.
                at = np.flatnonzero(classes == 0)
                classes = np.insert(classes, at, 0)
                codes = (classes[:-2] * SYMBOLS + classes[1:-1]) * SYMBOLS + classes[2:]
                total += np.bincount(codes, minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    return texts.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Costs (negative logarithms) of the third of three classes, smoothed by pairs and singles."""
    table = np.zeros(SYMBOLS**3)
    for code, n in counts.collect():  # at most SYMBOLS ** 3 rows
        table[code] = n
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    single = table.sum((0, 1)) + 1
    single /= single.sum()
    pair = table.sum(0) + 5 * single
    pair /= pair.sum(1, keepdims=True)
    triple = table + 5 * pair
    return -np.log(triple / triple.sum(2, keepdims=True)).astype(np.float32).ravel()


class Restorer:
    """Restores tokens under a language model of costs."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def _lattice(self, unit: str, apart: bool) -> list:
        places, i = [], 0
        while i < len(unit):
            c, run = unit[i], 1
            while i + run < len(unit) and unit[i + run] == c:
                run += 1
            if c.isalpha():
                options = [(c * run, 0.0)]
                if run > 2:
                    options += [(c, SHRINK), (c * 2, SHRINK)]
            else:
                options = [("", NOISE), (" ", BREAK)]
                options += [(letter, LOOKS_LIKE + 0.5 * (run - 1)) for letter in LOOKALIKES.get(c, "")]
                if run == 2:
                    options += [(letter * 2, LOOKS_LIKE + 0.5) for letter in LOOKALIKES.get(c, "")]
                if c == "*":
                    options += [(letter, MASKED) for letter in LETTERS]
            places.append(options)
            i += run
            if apart and i < len(unit):
                places.append([("", 0.0), (" ", BREAK)])
        return places

    def decode(self, unit: str, apart: bool = False) -> list:
        """The words of the cheapest path; the first in alphabetical order of equals."""
        costs, known = self.costs, {}
        paths = {(0, 0): (0.0, "")}
        for options in [*self._lattice(unit, apart), [(" ", 0.0)]]:
            further: dict = {}
            for (a, b), (cost, text) in paths.items():
                for said, extra in options:
                    total, x, y = cost + extra, a, b
                    for c in said:
                        k = known.get(c)
                        if k is None:
                            k = known[c] = _class_of(c)
                        if k == 0 and y == 0:
                            continue  # at an edge already
                        total += costs[(x * SYMBOLS + y) * SYMBOLS + k]
                        x, y = (0, 0) if k == 0 else (y, k)
                    best = further.get((x, y))
                    if best is None or (total, text + said) < best:
                        further[x, y] = (total, text + said)
            paths = further
        return min(paths.values())[1].split()

    def words(self, token: str) -> list:
        """Restored words of a lower-case token without spaces."""
        core = token.rstrip(EDGE).lstrip(FRONT)
        if core.isalpha() and not TRIPLE.search(core):
            return [core]
        if not any(c.isalpha() for c in core):
            return []
        found = []
        for first in range(0, len(core), UNIT):
            found += self.decode(core[first : first + UNIT])
        return found

    def spaced(self, text: str) -> list:
        """Words of the letters that stand apart in a lower-case text."""
        found = []
        for m in APART.finditer(text):
            unit = "".join(m.group().split())
            for first in range(0, len(unit), UNIT):
                found += self.decode(unit[first : first + UNIT], apart=True)
        return found


def features_of(words: list) -> set:
    found = set(words)
    for n in (3, 4, 5):
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


class Reader:
    """The features of texts, those of a token remembered."""

    def __init__(self, costs: np.ndarray, chosen: dict | None = None):
        self.restorer, self.chosen, self.known = Restorer(costs), chosen, {}

    def _kept(self, words: list) -> tuple:
        found = features_of(words)
        if self.chosen is None:
            return tuple(found)
        return tuple(self.chosen[f] for f in found if f in self.chosen)

    def read(self, text: str) -> set:
        text = text.lower()
        known, found = self.known, set()
        if len(known) > KEPT:
            known.clear()
        for token in set(text.split()):
            kept = known.get(token)
            if kept is None:
                kept = known[token] = self._kept(self.restorer.words(token))
            if kept:
                found.update(kept)
        if APART.search(text):
            found.update(self._kept(self.restorer.spaced(text)))
        return found


def _fitted(rows: list, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on (label, feature numbers) rows, by Nesterov's method."""
    y = np.array([label for label, _ in rows], float)
    sizes = [len(f) for _, f in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    col = np.concatenate([np.empty(0, np.int64), *[np.array(f, np.int64) for _, f in rows]])
    base = (y.sum() + 0.5) / (len(y) + 1)
    w, bias, ridge = np.zeros(n), math.log(base / (1 - base)), 1e-4
    if not len(col):
        return w, bias
    step = 4.0 / (1 + np.mean(np.array(sizes, float) ** 2) ** 0.5)
    ahead, ahead_bias = w.copy(), bias
    for t in range(1, 401):
        z = ahead_bias + np.bincount(row, ahead[col], len(rows))
        slope = 1 / (1 + np.exp(-z)) - y
        new = ahead - step * (np.bincount(col, slope[row], n) / len(rows) + ridge * ahead)
        new_bias = ahead_bias - step * slope.mean()
        pull = t / (t + 3)
        ahead, ahead_bias = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


class ToxicityModel:
    """What scoring needs: language model, feature numbers, weights, bias, least shares."""

    def __init__(self, costs: np.ndarray, chosen: dict, weights: np.ndarray, bias: float, sure: list):
        self.costs, self.chosen, self.bias, self.sure = costs, chosen, bias, sure
        self.weights = weights.tolist()

    def score(self, features: set) -> float:
        z = self.bias + sum(self.weights[f] for f in features)
        fitted = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
        return max([fitted, *(self.sure[f] for f in features if self.sure[f] >= SURE)])


def _least_share(toxic: int, n: int, z: float = 2.0) -> float:
    """Wilson's lower bound of a share."""
    share = toxic / n
    middle = share + z * z / (2 * n)
    return (middle - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Language model of all ``docs``; classifier of those in ``labels`` (``doc_id``, ``toxic``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    costs = language_model(trigram_counts(texts.select("text")))
    shared = spark.sparkContext.broadcast(costs)

    told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    labelled = texts.join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def count(batches):
        reader, toxic, clean, n = Reader(shared.value), Counter(), Counter(), [0, 0]
        for batch in batches:
            for label, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "text")), strict=True):
                n[label > 0] += 1
                (toxic if label > 0 else clean).update(reader.read(text))
        rows = [(f, toxic[f], clean[f]) for f in toxic.keys() | clean.keys()] + [("", n[1], n[0])]
        for first in range(0, len(rows), 1 << 16):
            cut = list(zip(*rows[first : first + (1 << 16)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cut[0], pa.string()), pa.array(cut[1], pa.int64()), pa.array(cut[2], pa.int64())],
                names=["feature", "toxic", "clean"],
            )

    counts = labelled.mapInArrow(count, "feature string, toxic bigint, clean bigint")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.withColumn("all", F.col("feature") == "")
    # The row of the empty feature counts the documents; features come by how much they tell.
    strong = counts.where("all OR (toxic >= 3 AND toxic > clean)")
    told_by = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    chosen = strong.where("NOT all").orderBy(F.desc(told_by), "feature").limit(FEATURES).collect()
    numbers = {r.feature: i for i, r in enumerate(chosen)}
    sure = [_least_share(r.toxic, r.toxic + r.clean) for r in chosen]
    given = spark.sparkContext.broadcast(numbers)

    def shown(batches):
        reader = Reader(shared.value, given.value)
        for batch in batches:
            rows = [sorted(reader.read(t)) for t in batch.column("text").to_pylist()]
            label = [int(x > 0) for x in batch.column("toxic").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], names=["label", "features"]
            )

    # At most FIT_ROWS rows of feature numbers (repeated ids aside), in a fixed order.
    rows = [(r.label, r.features) for r in labelled.mapInArrow(shown, "label int, features array<int>").collect()]
    weights, bias = _fitted(sorted(rows), len(chosen))
    return ToxicityModel(costs, numbers, weights, bias, sure)


def with_score(df: DataFrame, model: ToxicityModel, text_col: str, name: str = "score") -> DataFrame:
    """``df`` with the score of its text, from 0 to 1."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by SYMBOLS and FEATURES

    def score(batches):
        m = shared.value
        reader = Reader(m.costs, m.chosen)
        for batch in batches:
            scores = [m.score(reader.read(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=names)

    names = [*df.columns, name]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.select("*", text_of(text_col).alias("_hl_text")).mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are never learned from: a quarter, by a checksum of the id."""
    rest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4
    return rest == 2


def without_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is below ``threshold``."""
    model = fit(docs, labels.where(~held_out()), id_col, text_col)
    rows = packed(docs, text=F.col(text_col))
    return with_score(rows, model, "text").where(F.col("score") < threshold).select("row.*")
