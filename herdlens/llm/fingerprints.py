"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A text is cut into paragraphs: at line ends, and within a line after the marks
that end a sentence. Each paragraph is hashed to a wide vector and a document's
fingerprint is the sum of its paragraphs' vectors modulo 2^32, so it does not
depend on their order and paragraphs can be added and taken away later, without
the text (:func:`plus`, :func:`minus`). The vector has

* one count of paragraphs,
* ``DENSE`` numbers, each another hash of the paragraph: equal sums mean equal
  multisets but for a chance of 2^-256,
* ``SIGNS`` counters of the paragraphs whose hash has a given bit. Twice the
  counter less the paragraphs is a sum of random signs, and products of such
  sums estimate how many paragraphs two documents share ("tug of war" sketch:
  the error is about 1 / sqrt(SIGNS) of the paragraphs, whatever their number).
  Two counters share one long.

Everything is made of SQL functions on arrays within a row; nothing is exploded.

Defined results: null counts as the empty text, which has no paragraph and the
zero fingerprint; empty paragraphs are no paragraphs; two zero fingerprints are
alike by 1; texts that differ only in the order of paragraphs have equal
fingerprints; repeated rows repeat; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import text_of
from herdlens.operators.skew import numbered

DENSE = 8
SIGNS = 128
MASK = 0xFFFFFFFF
LANES = 0x100000001  # the lowest bit of either half of a long
PARAGRAPH_END = r"\n+|(?<=[.!?]) "


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_END), lambda p: p != "")


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def vector(parts: Column) -> Column:
    """The sum of the vectors of ``parts``, an array of texts."""
    low, lanes, zero = F.lit(MASK).cast("bigint"), F.lit(LANES), F.lit(0).cast("bigint")

    def dense(h):
        lower = F.aggregate(h, zero, lambda s, x: (s + x.bitwiseAND(low)).bitwiseAND(low))
        upper = F.aggregate(h, zero, lambda s, x: (s + F.shiftrightunsigned(x, 32)).bitwiseAND(low))
        return F.array(lower, upper)

    def signs(h):
        """Bits r and r + 32 of all hashes, counted side by side in one long."""

        def counted(r):
            return F.aggregate(
                h, zero, lambda s, x: s + F.call_function("shiftrightunsigned", x, r).bitwiseAND(lanes)
            )

        return F.transform(F.sequence(F.lit(0), F.lit(31)), counted)

    def numbers(p):
        kinds = [dense] * (DENSE // 2) + [signs] * (SIGNS // 64)
        sums = [_with(_hashes(p, seed), kind) for seed, kind in enumerate(kinds)]
        return F.concat(F.array(F.size(p).cast("bigint")), *sums)

    return _with(parts, numbers)


def _hashes(parts: Column, seed: int) -> Column:
    return F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    """Both halves of the longs added or subtracted, each modulo 2^32."""
    low = F.lit(MASK).cast("bigint")

    def both(x, y):
        upper = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(low)
        lower = (x.bitwiseAND(low) + sign * y.bitwiseAND(low)).bitwiseAND(low)
        return F.shiftleft(upper, 32).bitwiseOR(lower)

    return F.zip_with(a, b, both)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return _lanewise(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint without ``b``'s paragraphs, which must be among ``a``'s."""
    return _lanewise(a, b, -1)


def as_text(v: Column) -> Column:
    """Sixteen hexadecimal digits for each number."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared paragraphs, twice, by those of both, from the signs alone: 0 to 1.

    2 <a, b> / (<a, a> + <b, b>), each product the mean over the signs. Equal
    fingerprints are alike by 1, those of an empty and another text by 0.
    """
    low, zero = F.lit(MASK).cast("bigint"), F.lit(0.0)

    def products(v, w, half):
        return F.zip_with(
            F.slice(v, DENSE + 2, SIGNS // 2), F.slice(w, DENSE + 2, SIGNS // 2),
            lambda x, y: (2 * half(x) - v[0]).cast("double") * (2 * half(y) - w[0]).cast("double"),
        )

    def product(v, w):
        halves = [
            F.aggregate(products(v, w, h), zero, lambda s, x: s + x)
            for h in (lambda x: x.bitwiseAND(low), lambda x: F.shiftrightunsigned(x, 32))
        ]
        return halves[0] + halves[1]

    sizes = product(a, a) + product(b, b)
    estimate = F.when(sizes > 0, F.greatest(zero, F.least(F.lit(1.0), 2 * product(a, b) / sizes))).otherwise(zero)
    return F.when(a == b, F.lit(1.0)).otherwise(estimate)


def fingerprints(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the vector of its text."""
    return df.withColumn(name, vector(paragraphs(text_of(text_col))))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edited one: its second half from the next document.

    Next is the distinct document (id and text) that follows in descending order
    of ids (nulls last, equal ids by a digest of the text), after the last the
    first. Returns ``(doc_id, n_chars, edited, vector, edited_vector, next_id,
    next_chars, next_vector)``. Texts are shuffled once, halves of the following texts
    once; the order is found on digests alone.
    """
    text = text_of(text_col)
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(" "), text).cast("binary"))
    rows = docs.select(
        key.alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"), F.char_length(text).cast("bigint").alias("n_chars")
    )
    distinct = rows.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"))
    placed = numbered(distinct, [F.desc_nulls_last("doc_id"), "key"], "at")
    count = F.lit(max(1, placed.count()))
    # The row that a document's beginning goes to: the one before it in the order.
    before = placed.select(
        F.col("key").alias("to"), (F.floor(F.col("n_chars") / 2)).cast("int").alias("half"),
        (F.pmod(F.col("at"), count) + 1).alias("at"),
    )
    targets = placed.select("key", "at").join(before, "at").select("key", "to", "half")

    # Both joins need the same columns, so that their common shuffle is made once.
    texts = fingerprints(rows, name="vector")
    sent = texts.join(targets, "key").select(
        "to",
        F.struct(
            F.col("text").substr(F.lit(1), F.col("half")).alias("head"), F.col("doc_id").alias("id"),
            F.col("n_chars").alias("n"), "vector",
        ).alias("next"),
    )
    following = sent.groupBy(F.col("to").alias("key")).agg(F.first("next").alias("next"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), kept), F.col("next.head"))
    return texts.join(following, "key").select(
        "doc_id", "n_chars", edited.alias("edited"), "vector",
        vector(paragraphs(edited)).alias("edited_vector"),
        F.col("next.id").alias("next_id"), F.col("next.n").alias("next_chars"),
        F.col("next.vector").alias("next_vector"),
    )
