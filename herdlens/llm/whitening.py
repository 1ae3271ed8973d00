"""Whitening of embeddings by a covariance over distinct vectors with multiplicities.

Entries are put on a whole-number grid, so equal vectors are equal bytes: those
are the grouping key, one or two bytes an entry as a rule. Each distinct vector
is kept once with the number of its rows. The fit is three aggregations over the
distinct vectors: exact sums for each dimension, the covariance as weighted
matrix products of rows centred beforehand (a partial matrix for each task, summed
row by row), and after the projection the same for the whitened vectors, which
measures how far their covariance is from the identity. Every distinct vector is
whitened once and joined back to its rows by its bytes. Only sums and matrices of
the dimensions reach the driver.

Defined results: rows whose vector is null, empty, or holds a null or a
non-finite entry are dropped, and so are those of another length than that of
most distinct vectors (of equals, the longer). Entries beyond 2^61 steps of the
grid count as 2^61. Components whose eigenvalue is nothing but rounding have the
whitened value 0 and are left out of the identity error. A deviation beyond a
64-bit integer is null. Repeated rows stay, each with the values of its vector.
An empty table gives no rows. Further columns travel in a struct, so their names
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm.common import bounded_batches
from herdlens.llm.vectors import doubles, matrices
from herdlens.session import materialize

FAR = 1 << 61  # steps of the grid; sums of two stay in 64 bits


def _packed(grid: np.ndarray) -> list:
    """Each row as bytes: the width of an entry, then the entries, in the least width that holds them."""
    most = np.abs(grid).max(axis=1)
    widths = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out = np.empty(len(grid), object)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        raw = np.ascontiguousarray(grid[rows].astype(f"<i{width}")).view("u1").reshape(len(rows), -1)
        tagged = np.concatenate([np.full((len(rows), 1), width, "u1"), raw], axis=1)
        out[rows] = [r.tobytes() for r in tagged]
    return out.tolist()


def _unpacked(keys: list, size: int) -> np.ndarray:
    grid = np.empty((len(keys), size), "int64")
    widths = np.array([k[0] for k in keys], "u1")
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        raw = np.frombuffer(b"".join([keys[i] for i in rows]), "u1").reshape(len(rows), -1)
        grid[rows] = np.ascontiguousarray(raw[:, 1:]).view(f"<i{width}")
    return grid


@dataclass(frozen=True)
class Whitening:
    """Fitted on the grid: exact sums of ``n`` vectors, components and their eigenvalues."""

    n: int
    sums: tuple  # whole numbers, one for each dimension
    components: np.ndarray  # a column for each component
    values: np.ndarray
    trace: float

    @property
    def bases(self) -> np.ndarray:
        """The mean of each dimension, rounded."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], "int64")

    def rests(self) -> list:
        return [s - self.n * b for s, b in zip(self.sums, self.bases.tolist(), strict=True)]

    def centred(self, grid: np.ndarray) -> np.ndarray:
        """Distance from the mean; the whole part of it is taken exactly."""
        return (grid - self.bases) - np.array([r / self.n for r in self.rests()])

    def scales(self) -> np.ndarray:
        """One over the deviation of each component, 0 where there is none."""
        noise = max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps
        return np.array([1 / np.sqrt(v) if v > noise else 0.0 for v in self.values])

    def explained(self) -> list:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]

    def whitened(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ self.components * self.scales()

    def deviations(self, grid: np.ndarray) -> list:
        """Sums over dimensions of (n x - S)^2, in whole numbers of any size."""
        gaps, rests = grid - self.bases, self.rests()
        most, rest = int(np.abs(gaps).max(initial=0)), max(map(abs, rests), default=0)
        exact = "int64" if max(most, 1) * max(most, rest, 1) * len(rests) < 1 << 62 else object
        gaps = gaps.astype(exact)
        squares = (gaps * gaps).sum(axis=1).astype(object)
        crossed = (gaps * np.array(rests, exact)).sum(axis=1).astype(object)
        own = sum(r * r for r in rests)
        return (self.n * (self.n * squares - 2 * crossed) + own).tolist()


def _whole_sums(grid: np.ndarray, weights: np.ndarray) -> list:
    most = int(np.abs(grid).max(initial=0)) * int(weights.sum())
    exact = "int64" if most < 1 << 62 else object
    return [int(s) for s in (grid.astype(exact) * weights.astype(exact)[:, None]).sum(axis=0)]


def _sums(df: DataFrame, size: int) -> tuple:
    """Total weight and exact sum of each dimension over ``(key, weight)``."""

    def partial(batches):
        n, total = 0, [0] * size
        for batch in batches:
            weights = batch.column("weight").to_numpy(zero_copy_only=False)
            grid = _unpacked(batch.column("key").to_pylist(), size)
            n += int(weights.sum())
            total = [a + b for a, b in zip(total, _whole_sums(grid, weights), strict=True)]
        if n:
            # In two halves, so that no sum leaves its 64 bits.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
                    pa.array([t >> 31 for t in total], pa.int64()), pa.array([t & 0x7FFFFFFF for t in total], pa.int64()),
                ],
                names=["dim", "n", "high", "low"],
            )

    parts = df.mapInArrow(partial, "dim int, n bigint, high bigint, low bigint")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    rows.sort(key=lambda r: r["dim"])
    return (rows[0]["n"] if rows else 0), tuple((r["high"] << 31) + r["low"] for r in rows)


def _covariance(df: DataFrame, columns: list, size: int, n: int, centred) -> np.ndarray:
    """Sum over rows of weight times the outer product of ``centred(batch)``, over ``n``.

    A task adds up one matrix; the matrices of all tasks are summed line by line.
    """

    def partial(batches):
        total, seen = np.zeros((size, size)), False
        for batch in batches:
            weights = batch.column("weight").to_numpy(zero_copy_only=False).astype("f8")
            gaps, seen = centred(batch), True
            total += (gaps * weights[:, None]).T @ gaps
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
                names=["line", "entries"],
            )

    def summed(table: pa.Table) -> pa.Table:
        entries = sum(np.frombuffer(b, "<f8") for b in table.column("entries").to_pylist())
        return pa.table({"line": table.column("line")[:1], "entries": pa.array([entries.tobytes()], pa.binary())})

    lines = df.select("weight", *columns).mapInArrow(partial, "line int, entries binary")
    rows = lines.groupBy("line").applyInArrow(summed, "line int, entries binary").collect()  # one for each dimension
    out = np.zeros((size, size))
    for row in rows:
        out[row["line"]] = np.frombuffer(row["entries"], "<f8")
    return (out + out.T) / 2 / n


def _components(covariance: np.ndarray, most: int) -> tuple:
    """Eigenvalues from the largest, and unit eigenvectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """``(key, copies)`` of the distinct vectors of the commonest length, and that length."""
    groups = materialize(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies")), "vectors-distinct")
    longest = groups.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size = longest["size"] if longest else 0
    return groups.where(F.col("size") == size).select("key", "copies"), size


def whiten(
    df: DataFrame, vector_col: str = "embedding", keep: list | None = None, components: int = 16, scale: float = 64.0,
    fit_weights: str = "one",
) -> DataFrame:
    """``(row, n, deviation, whitened, explained, identity_error)`` of each usable row.

    ``row`` holds the columns ``keep`` (all but the vector if not given). Entries
    are floor(scale * entry); a fixed offset added to them would change nothing of
    the result. ``fit_weights`` is ``one`` (each distinct vector once) or ``count``
    (as often as it occurs). ``whitened`` and ``explained`` have an entry for each
    of the first ``components`` components.
    """
    if fit_weights not in ("one", "count"):
        raise ValueError("fit_weights is 'one' or 'count'")
    bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if c != vector_col] if keep is None else keep
    packed = df.select((F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))).alias("row"), doubles(vector_col).alias("vector"))

    def keys(batches):
        for batch in batches:
            for rows, matrix in matrices(batch.column("vector")):
                if len(rows):
                    grid = np.clip(np.floor(scale * matrix), -FAR, FAR).astype("int64")
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row").take(pa.array(rows)), pa.array(_packed(grid), pa.binary()),
                            pa.array(np.full(len(rows), matrix.shape[1], "int32")),
                        ],
                        names=["row", "key", "size"],
                    )

    carried = packed.schema["row"]
    schema = T.StructType([carried, T.StructField("key", T.BinaryType()), T.StructField("size", T.IntegerType())])
    rows = materialize(packed.mapInArrow(keys, schema), "vectors-packed")
    distinct, size = distinct_vectors(rows)
    weighted = distinct.select("key", (F.lit(1) if fit_weights == "one" else F.col("copies")).cast("bigint").alias("weight"))
    n, sums = _sums(weighted, size)
    if not n:
        several = T.ArrayType(T.DoubleType())
        told = [("n", T.LongType()), ("deviation", T.LongType()), ("whitened", several), ("explained", several), ("identity_error", T.DoubleType())]
        return df.sparkSession.createDataFrame([], T.StructType([carried, *[T.StructField(*f) for f in told]]))

    mean = Whitening(n, sums, np.eye(size), np.ones(size), 0.0)
    covariance = _covariance(
        weighted, ["key"], size, n, lambda batch: mean.centred(_unpacked(batch.column("key").to_pylist(), size))
    )
    values, vectors = _components(covariance, components)
    model = Whitening(n, sums, vectors, values, float(np.trace(covariance)))

    def apply(batches):
        for batch in batches:
            grid = _unpacked(batch.column("key").to_pylist(), size)
            told = model.deviations(grid)
            flat = model.whitened(grid)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("weight"),
                    pa.array([d if d < 1 << 63 else None for d in told], pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(grid) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel())
                    ),
                ],
                names=["key", "weight", "deviation", "whitened"],
            )

    done = materialize(
        weighted.mapInArrow(apply, "key binary, weight bigint, deviation bigint, whitened array<double>"), "vectors-whitened"
    )
    error = _identity_error(done, model, n)
    told = done.select(F.col("key").alias("_key"), "deviation", "whitened")
    return rows.join(told, rows["key"] == told["_key"]).select(
        "row",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(v) for v in model.explained()]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(done: DataFrame, model: Whitening, n: int) -> float:
    """How far the covariance of the whitened fit vectors is from the identity, at most."""
    k = len(model.values)
    totals = done.select(
        *[F.sum(F.col("whitened")[i] * F.col("weight")).alias(f"s{i}") for i in range(k)]
    ).first()
    mean = np.array([t / n for t in totals])

    def centred(batch):
        return batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean

    varied = model.scales() > 0
    off = np.abs(_covariance(done, ["whitened"], k, n, centred) - np.eye(k))[np.ix_(varied, varied)]
    return float(off.max(initial=0.0))
