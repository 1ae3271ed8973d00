"""Alignment, neighbours and whitening against brute force, and their edge cases."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from herdlens.llm import alignment, chunks, neighbours, perfect_hash, whitening
from herdlens.llm.queries import llm_queries

SMALL = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b ", "a\n", "\n", "a\nb", "a\n\nb", "a\n b \n\n  c", "▁a ▁▁ b", "x▁y", "<s> <0x41>",
    "<|endoftext|> <s> </s>", "日本語 テスト é", "a\r\nb", "\t\r\n 　c", "\x1c a", "a  b", "it's don't  'll", "w" * 3000,
    "  x  ​", "http://a.b/c?d=e ...  !!", "def f(x):\n        return x",
]


class Brute:
    """Alignment from whole texts, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.letters = alignment._byte_letters()

    def tokens(self, text):
        a = self.a.encode(f" {text}", add_special_tokens=False)
        ids_b = self.b.encode(text)
        first = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        second = [
            (i, bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
            for i in ids_b
        ]
        same = all(b"".join(t for _, t in x) == f" {text}".encode() for x in (first, second))
        return (first, second) if text and same else None

    @staticmethod
    def ranges(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def document(self, text):
        found = self.tokens(text or "")
        if found is None:
            return None
        a, b = map(self.ranges, found)
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e] if len(a) < 400 else self.sweep(a, b)
        groups, start = [], 0
        for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in x if start <= s and e <= end) for x in (a, b)))
            start = end
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    @staticmethod
    def sweep(a, b):
        links, first = [], 0
        for i, s, e in a:
            while b[first][2] <= s:
                first += 1
            j = first
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        return links

    def corpus(self, texts):
        docs = [self.document(t) for t in texts]
        counts = Counter(x for d in docs if d for x in d[3])
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(best.get(b, 0), n)
        return [
            (0, 0, 0, 0, 0, 0, "") if d is None
            else (*d[:3], len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4])
            for d in docs
        ]


# --- Alignment --------------------------------------------------------------
def test_alignment_of_odd_texts_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 8)  # many shards
    monkeypatch.setattr(alignment, "PART", 4)  # a tree of several steps
    texts = ODD + ["a  b ", "it's don't  'll"]
    rows = [(i, t, i, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block long, pair string, n int").repartition(5)
    found = alignment.aligned(df, BYTES, PIECES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == Brute().corpus(texts)


def test_alignment_encodes_a_remembered_chunk_once(monkeypatch):
    align, seen, tokens = alignment.Aligner(BYTES, PIECES), [], alignment.Aligner._tokens

    def noted(self, runs, chunks):
        seen.extend(chunks[i] for run in runs for i in run)
        return tokens(self, runs, chunks)

    monkeypatch.setattr(alignment.Aligner, "_tokens", noted)
    chunks_of = [[" one", " two,", "\nthree", " \u00e9t\u00e9", " \u00a0x ", " " + "y" * 100], [" two,", " four", " one", " " + "y" * 100]]
    first, second = map(align, chunks_of)
    assert sorted(set(seen)) == sorted({c for x in chunks_of for c in x})
    assert seen.count(" one") == seen.count(" two,") == 1 and seen.count(" " + "y" * 100) == 2  # long ones are not kept
    fresh = alignment.Aligner(BYTES, PIECES)(chunks_of[1])
    for got, expected in zip(second, fresh, strict=True):
        assert got.tolist() == expected.tolist()
    assert second.texts() == fresh.texts()


def test_alignment_of_no_and_of_null_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty, BYTES, PIECES).count() == 0
    df = spark.createDataFrame([(None, None), (None, ""), (1, None)], "doc_id long, text string")
    assert sorted(r[1:] for r in alignment.aligned(df, BYTES, PIECES).collect()) == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_alignment_of_very_long_texts(spark):
    spaced, solid = "lorem ipsum dolor, sit\namet " * 40_000, "ab1" * 350_000  # a megabyte each
    df = spark.createDataFrame([(1, spaced), (2, solid), (3, spaced)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.aligned(df, BYTES, PIECES).collect()}
    brute = Brute()
    for i, text in ((1, spaced), (2, solid)):
        a, b = brute.tokens(text)
        assert (got[i].n_a, got[i].n_b) == (len(a), len(b)) and got[i].n_links >= max(len(a), len(b))
    assert got[1][1:] == got[3][1:]


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = Brute().corpus([r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in llm_queries()["op11_alignment"](spark, SMALL).collect()}
    assert [got[r.doc_id] for r in rows] == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t. é'1"), min_size=1, max_size=30), min_size=1, max_size=4))
def test_chunks_put_together_are_the_text(texts):
    seen = {}
    for cut in chunks.chunked(pa.array(texts)):
        for k, row in enumerate(cut.rows.tolist()):
            seen[row] = "".join(cut.chunks[i] for i in cut.index[cut.ends[k] : cut.ends[k + 1]])
    assert seen == {i: f" {t}" for i, t in enumerate(texts)}


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 1 << 62), max_size=3000))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), "int64")
    made = perfect_hash.PerfectHash.build(keys)
    again = perfect_hash.PerfectHash(made.sizes, made.bits)
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError, match="distinct"):
        perfect_hash.PerfectHash.build(np.array([5, 5]))


# --- Neighbours -------------------------------------------------------------
def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def brute_neighbours(rows, k):
    out = []
    for i, (q, v) in enumerate(rows):
        if q is None or q % 50 or not usable(v):
            continue
        others = [(n, w) for j, (n, w) in enumerate(rows) if j != i and usable(w) and len(w) == len(v)]
        best = sorted(((-cosine(v, w), n is None, n) for n, w in others), key=lambda x: (round(x[0], 12), *x[1:]))[:k]
        out += [(q, rank, n, -s) for rank, (s, _, n) in enumerate(best, 1)]
    return out


def same_neighbours(found, expected):
    found = sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))
    expected = sorted(expected, key=lambda r: (r[0], r[1], r[2] or 0))
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in found], [r[3] for r in expected], rtol=0, atol=1e-12)


def test_neighbours_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(9).tolist()) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(8)]  # ties with a query, larger ids
    rows += [(400, None), (450, []), (500, [0.0] * 9), (550, [float("nan")] + [1.0] * 8), (600, [None] + [1.0] * 8)]
    rows += [(650, [1.0, 2.0]), (651, [2.0, 4.0]), (652, [-1.0, 0.5])]  # another length, fewer than k
    rows += [(700, [3.0] * 5), (100, rows[100][1]), (None, rows[50][1])]  # alone, a repeated query, no id
    rows += [(750, (np.array(rows[7][1]) * 1e200).tolist()), (751, (np.array(rows[7][1]) * 1e-200).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit(1) for c in ("row", "id", "query", "vector", "down", "across")}).repartition(3)
    found = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()]
    expected = brute_neighbours(rows, 5)
    assert any(r[0] == 650 for r in found) and not any(r[0] == 700 for r in found)
    assert Counter(r[0] for r in found)[100] == 10  # each of the two rows has its own five
    same_neighbours(found, expected)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [3, 64, 200])
def test_neighbours_of_clusters_in_small_tiles(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((6, size)) * 2
    x = centres[rng.integers(0, 6, 1500)] + rng.standard_normal((1500, size))
    x[:500] = centres[0] + rng.standard_normal((500, size)) / 20  # a third of all rows close together
    rows = list(enumerate(x.astype("f4").astype(float).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()]
    expected = brute_neighbours(rows, 5)
    common = {r[:1] + r[2:3] for r in found} & {r[:1] + r[2:3] for r in expected}
    assert len(found) == len(expected) and len(common) >= 0.99 * len(expected)


def test_neighbours_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = [tuple(r) for r in llm_queries()["op12_neighbours"](spark, SMALL).collect()]
    expected = brute_neighbours([(r[0], r[1]) for r in rows], 5)
    common = {(r[0], r[2]) for r in found} & {(r[0], r[2]) for r in expected}
    assert len(found) == len(expected) and len(common) >= 0.9 * len(expected)


# --- Whitening --------------------------------------------------------------
def brute_whitening(x, weights=None, k=16):
    u, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(u), int)
    n, s = int(w.sum()), [sum(int(a) * int(b) for a, b in zip(w, c)) for c in u.T]
    mean = np.array([t / n for t in s])
    gaps = u - mean
    covariance = (gaps * w[:, None]).T @ gaps / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - t) ** 2 for a, t in zip(row, s)) for row in x]
    return n, deviation, (x - mean) @ vectors / np.sqrt(values), values / np.trace(covariance)


def check_whitening(got, x, weights=None, k=16):
    n, deviation, white, explained = brute_whitening(x, weights, k)
    mine = np.array([r.whitened for r in got])
    signs = np.sign((mine * white).sum(axis=0))
    assert {r.n for r in got} == {n}
    assert [r.deviation for r in got] == [d if d < 1 << 63 else None for d in deviation]
    assert np.allclose(mine, white * signs, atol=1e-8)
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and got[0].identity_error < 1e-6


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_with_copies_and_bad_rows(spark, weights):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 6)) * 3, 2)
    x[:100] = x[0]  # a third of all rows are equal
    x[100] = [700.0, -900.0, 1e3, 0.1, 0.2, 0.3]  # wider entries
    bad = [None, [], [1.0] * 5, [float("inf")] + [0.0] * 5, [None] + [0.0] * 5]
    rows = [(i, v) for i, v in enumerate([*x.tolist(), *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    df = df.withColumns({c: F.lit(1) for c in ("row", "key", "n", "weight", "whitened")})
    got = sorted(whitening.whiten(df, components=4, fit_weights=weights).collect(), key=lambda r: r.row.vec_id)
    assert len(got) == 300 and got[0].row.whitened == 1
    check_whitening(got, np.floor(64 * x).astype("int64"), weights, 4)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [0.0, 0.0], [0.0, 0.0], 0.0)] * 2
    line = [(i, [float(i), 2.0 * i, 1e300]) for i in range(4)]
    rows = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect()
    assert all(r.whitened[1:] == [0.0, 0.0] for r in rows) and rows[0].identity_error < 1e-9


def test_deviations_of_any_size():
    grid = np.array([[1 << 40, -(1 << 40)], [5, 6], [-7, 1 << 60]])
    sums = [int(c) for c in grid.astype(object).sum(axis=0)]
    model = whitening.Whitening(3, tuple(sums), np.eye(2), np.ones(2), 1.0)
    assert model.deviations(grid) == [sum((3 * int(x) - s) ** 2 for x, s in zip(r, sums)) for r in grid]


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    found = llm_queries()["op13_whitening"](spark, SMALL)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.floor(64 * np.array([r.embedding for r in rows], float)).astype("int64") + 1_000_000
    got = found.orderBy("vec_id", "component").collect()
    n, deviation, white, explained = brute_whitening(x)
    mine = np.array([r.whitened for r in got]).reshape(-1, 16)
    assert np.allclose(mine, white * np.sign((mine * white).sum(axis=0)), atol=1e-7)
    assert [r.deviation for r in got[::16]] == deviation and {r.n for r in got} == {n}
    assert np.allclose([r.explained for r in got[:16]], explained) and got[0].identity_error < 1e-4
