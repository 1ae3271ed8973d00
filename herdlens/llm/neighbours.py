"""Approximate nearest neighbours by randomly rotated one-bit codes.

After Gao and Long, "RaBitQ: Quantizing High-Dimensional Vectors with a
Theoretical Error Bound" (2024). Unit vectors are centred on their mean, made unit
again and rotated at random into ``BITS`` times as many dimensions; the signs are
the code. Besides the code a row keeps how far it lies from the mean, how well its
code fits it (the correction of the estimate), and its product with the mean. A
query is rotated alike and put on 256 levels, so that products with codes are bit
counts of packed words. Each estimate comes with an error bound; the vectors whose
bound reaches the k-th best score so far are scored exactly, in double precision,
and nothing else decides the result.

The stated queries meet all rows in tiles: rows and queries are dealt into tiles of
bounded size, each pair of tiles is one small task that returns its best k for each
query, and the best k of those are kept. No code is skipped and no candidate
capped; what is approximate is that an error bound holds with high probability
only (``BOUND`` deviations).

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite
entry take no part; vectors are compared with those of their own length only; ties
go to the smaller id, null last; a query excludes its own row, not other rows with
its id or its vector; each of several query rows with one id has its own k rows; a
query with fewer candidates than k returns all of them, one with none returns
nothing; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm.common import bounded_batches
from herdlens.llm.vectors import doubles, matrices
from herdlens.session import materialize

BITS = 4  # bits of a code for each entry of a vector
BOUND = 3.0  # deviations of the estimate within which a vector is scored exactly
ROWS, QUERIES = 8192, 4096  # rows and queries of a tile at most, as dealt by hash
SPREAD = 1024  # rows of a tile at least, where there are more tasks to fill
TOGETHER = 1 << 19  # estimates held at once


@lru_cache(maxsize=4)
def rotation(size: int, seed: int) -> np.ndarray:
    """A random map of ``size`` dimensions into those of a code, which keeps products."""
    wide = 64 * math.ceil(BITS * size / 64)
    drawn = np.random.default_rng([seed, size]).standard_normal((wide, size))
    return np.ascontiguousarray(np.linalg.qr(drawn)[0].T)


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; products keep their digits."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _residuals(matrix: np.ndarray, centre: np.ndarray) -> tuple:
    """Distance from the centre, direction from it, and product with it, of unit vectors."""
    unit = matrix / _norms(matrix)[:, None]
    gaps = unit - centre
    far = _norms(gaps)
    return far, gaps / np.maximum(far, 1e-300)[:, None], unit @ centre


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(matrix)], pa.binary())


def _centres(df: DataFrame) -> dict:
    """The mean unit vector of each length."""

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            for _, matrix in matrices(batch.column("vector")):
                matrix = _scaled(matrix[np.abs(matrix).max(axis=1) > 0])
                n, total = sums.get(matrix.shape[1], (0, 0.0))
                sums[matrix.shape[1]] = n + len(matrix), total + (matrix / _norms(matrix)[:, None]).sum(axis=0)
        told = [(size, n, t.tobytes()) for size, (n, t) in sums.items() if n]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*told, strict=True)], names=["size", "n", "total"])

    def summed(table: pa.Table) -> pa.Table:
        n = sum(table.column("n").to_pylist())
        total = sum(np.frombuffer(b) for b in table.column("total").to_pylist())
        return pa.table({"size": table.column("size")[:1], "centre": pa.array([(total / n).tobytes()], pa.binary())})

    parts = df.select("vector").mapInArrow(partial, "size bigint, n bigint, total binary")
    rows = parts.groupBy("size").applyInArrow(summed, "size bigint, centre binary").collect()  # one for each length
    return {r["size"]: np.frombuffer(r["centre"]) for r in rows}


def code_index(df: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> tuple[DataFrame, dict]:
    """Codes and corrections of all usable rows, written, and the centre of each length."""
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(query, F.lit(False)).alias("query"), doubles(vector_col).alias("vector"),
    )
    centres = _centres(rows)

    def encode(batches):
        for batch in batches:
            for at, matrix in matrices(batch.column("vector")):
                used = np.abs(matrix).max(axis=1) > 0
                at, matrix = at[used], matrix[used]
                if not len(at):
                    continue
                far, ways, along = _residuals(_scaled(matrix), centres[matrix.shape[1]])
                turned = ways @ rotation(matrix.shape[1], seed)
                fit = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
                single = matrix.astype("f4")
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(pa.array(at)) for c in ("row", "id", "query")],
                        pa.array(np.full(len(at), matrix.shape[1], "int32")),
                        _bytes(single if (single == matrix).all() else matrix),
                        _bytes(_words(turned > 0)), pa.array(far), pa.array(fit), pa.array(along),
                    ],
                    names=["row", "id", "query", "size", "vector", "code", "far", "fit", "along"],
                )

    more = {"size": T.IntegerType(), "vector": T.BinaryType(), "code": T.BinaryType()}
    more |= {c: T.DoubleType() for c in ("far", "fit", "along")}
    schema = T.StructType([*[rows.schema[c] for c in ("row", "id", "query")], *[T.StructField(c, t) for c, t in more.items()]])
    return materialize(rows.mapInArrow(encode, schema), "codes"), centres


def _vectors(table: pa.Table, size: int) -> np.ndarray:
    stored = table.column("vector").to_pylist()
    out = np.empty((len(stored), size))
    for i, raw in enumerate(stored):
        out[i] = np.frombuffer(raw, "<f4" if len(raw) == 4 * size else "<f8")
    return _scaled(out)


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class _Queries:
    """Rotated queries on 256 levels, as bit planes."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.vectors, self.norms = vectors, _norms(vectors)
        self.far, ways, self.along = _residuals(vectors, centre)
        turned = ways @ turn
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / 255, 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype("u1")
        rounded = self.low[:, None] + self.step[:, None] * levels
        self.total = rounded.sum(axis=1)
        self.off = np.abs(turned - rounded).sum(axis=1)  # what the levels may change in a sum
        self.planes = [_words(levels >> j & 1) for j in range(8)]

    def counts(self, part: slice, code: np.ndarray) -> np.ndarray:
        """Sum of the levels where a code has a one, for each query and code."""
        out = np.zeros((part.stop - part.start, len(code)), "int64")
        for j, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                out += np.bitwise_count(plane[part, w][:, None] & code[:, w]).astype("int64") << j
        return out


def _scores(a: np.ndarray, b: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1) / norms


def _best_of_tile(rows: pa.Table, asked: pa.Table, size: int, centre: np.ndarray, k: int, bound: float, seed: int):
    """Per query of ``asked`` the k best of ``rows``: places of both and scores."""
    turn = rotation(size, seed)
    root, wide = math.sqrt(turn.shape[1]), turn.shape[1]
    vectors = _vectors(rows, size)
    norms = _norms(vectors)
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), "<u8").reshape(len(vectors), -1)
    ones = np.bitwise_count(code).sum(axis=1).astype("f8")
    far, fit, along = (_floats(rows, c) for c in ("far", "fit", "along"))
    fit = np.maximum(fit, 1e-300)
    spread = bound * np.sqrt(np.maximum(1 - fit * fit, 0)) / math.sqrt(wide - 1)
    row, own = rows.column("row").to_numpy(), asked.column("row").to_numpy()
    queries = _Queries(_vectors(asked, size), centre, turn)
    first = min(k, len(vectors))
    for start in range(0, len(own), max(1, TOGETHER // len(vectors))):
        part = slice(start, min(start + max(1, TOGETHER // len(vectors)), len(own)))
        low, step, total, off = (x[part, None] for x in (queries.low, queries.step, queries.total, queries.off))
        inside = (2 * (low * ones + step * queries.counts(part, code)) - total) / root / fit
        reach = queries.far[part, None] * far
        about = reach * inside + along + queries.along[part, None] - centre @ centre
        upper = about + reach * (spread + off / root) / fit
        same = own[part, None] == row
        about[same] = upper[same] = -np.inf
        # Score the best estimates first: the k-th best score is what others have to reach.
        top = np.argpartition(-about, first - 1, axis=1)[:, :first]
        lead = _scores(
            queries.vectors[part, None, :], vectors[top], queries.norms[part, None] * norms[top]
        )
        lead[np.take_along_axis(same, top, axis=1)] = -np.inf
        least = lead.min(axis=1) if first == k else np.full(len(lead), -np.inf)
        chosen = upper >= least[:, None] - 1e-9
        np.put_along_axis(chosen, top, True, axis=1)
        chosen &= ~same
        q, v = np.nonzero(chosen)
        score = np.concatenate([
            _scores(
                queries.vectors[q[i : i + 65536] + start], vectors[v[i : i + 65536]],
                queries.norms[q[i : i + 65536] + start] * norms[v[i : i + 65536]],
            )
            for i in range(0, len(q), 65536)
        ] or [np.empty(0)])
        order = np.lexsort((v, -score, q))  # rows are in order of their ids
        q, v, score = q[order], v[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < k
        yield q[kept] + start, v[kept], score[kept]


def nearest(
    df: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    bound: float = BOUND, seed: int = 7,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the k rows of largest cosine for each row where ``query`` holds."""
    spark = df.sparkSession
    index, centres = code_index(df, query, id_col, vector_col, seed)
    counted = index.agg(F.count(F.lit(1)).alias("rows"), F.count_if("query").alias("queries")).first()
    across = max(1, math.ceil(counted["queries"] / QUERIES))
    tasks = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / across)
    down = max(1, math.ceil(counted["rows"] / ROWS), min(tasks, math.ceil(counted["rows"] / SPREAD)))

    def dealt(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        placed = side.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    rows = dealt(index.drop("query"), "down", down, "across", across)
    asked = dealt(index.where("query").select("row", "id", "size", "vector"), "across", across, "down", down)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("id", "ascending"), ("row", "ascending")])  # null ids last
        found = []
        for size in np.unique(right.column("size").to_numpy()).tolist():
            mine, theirs = (t.filter(pa.compute.equal(t.column("size"), size)) for t in (left, right))
            if not mine.num_rows:
                continue
            for q, v, score in _best_of_tile(mine, theirs, size, centres[size], k, bound, seed):
                found.append(pa.table({
                    "query_row": theirs.column("row").take(q), "query_id": theirs.column("id").take(q),
                    "row": mine.column("row").take(v), "id": mine.column("id").take(v), "score": pa.array(score),
                }))
        return pa.concat_tables(found) if found else wanted.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = index.schema["id"].dataType
    schema = T.StructType([
        T.StructField("query_row", T.LongType()), T.StructField("query_id", kind), T.StructField("row", T.LongType()),
        T.StructField("id", kind), T.StructField("score", T.DoubleType()),
    ])
    wanted = to_arrow_schema(schema)
    best = asked.groupBy("down", "across").cogroup(rows.groupBy("down", "across"))
    each = best.applyInArrow(lambda right, left: tile(left, right), schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
