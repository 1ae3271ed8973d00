"""Robust Student-t mixture with fixed degrees of freedom (McLachlan and Peel).

Each EM iteration is one aggregation of sufficient statistics over the points.
Equal points are combined first and carry a weight, so iterations read the
distinct severity profiles, not the reports. Only k x d x d numbers reach the
driver. Parameters enter the plan as the columns of a one-row table, so every
iteration runs the same query and the same generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.config import DEFAULT, Config
from herdlens.functions.numeric import lit_double

PARAMETERS = "@parameters"
TINY = 1e-300  # keeps logarithms and divisions of empty components finite


@dataclass(frozen=True)
class Parameters:
    means: np.ndarray
    covariances: np.ndarray
    weights: np.ndarray

    @property
    def k(self) -> int:
        return self.means.shape[0]

    @property
    def d(self) -> int:
        return self.means.shape[1]

    def numbers(self, dof: float) -> dict:
        """Named values the expressions of the E-step need."""
        d = self.d
        out = {}
        for k in range(self.k):
            precision = np.linalg.inv(self.covariances[k])
            _, log_det = np.linalg.slogdet(self.covariances[k])
            out[f"c{k}"] = (
                math.lgamma((dof + d) / 2) - math.lgamma(dof / 2)
                - d / 2 * math.log(dof * math.pi) - log_det / 2
                + math.log(self.weights[k] + TINY)
            )
            for i in range(d):
                out[f"m{k}_{i}"] = self.means[k, i]
                for j in range(i, d):
                    out[f"p{k}_{i}_{j}"] = precision[i, j] * (1.0 if i == j else 2.0)
        return {name: float(value) for name, value in out.items()}


def _level(inner: str, *columns: str) -> str:
    return f"SELECT *, {', '.join(columns)} FROM ({inner})"


def _log_densities(source: str, keep: list, names: list, k: int, dof: float, number) -> str:
    """Query that adds each component's weighted log-density ``_l<k>`` and the greatest, ``_top``.

    ``number`` writes out a named parameter. One level per stage, so that no
    expression is written twice.
    """
    d = len(names)
    comps = range(k)

    def distance(c: int) -> str:
        gaps = [f"({x} - {number(f'm{c}_{i}')})" for i, x in enumerate(names)]
        terms = [
            f"{gaps[i]} * {gaps[j]} * {number(f'p{c}_{i}_{j}')}" for i in range(d) for j in range(i, d)
        ]
        return " + ".join(terms)

    kept = ", ".join(keep)
    consts = ", ".join(f"{number(f'c{c}')} AS _c{c}" for c in comps)
    query = f"SELECT {kept}, {consts}, {', '.join(f'{distance(c)} AS _d{c}' for c in comps)} FROM {source}"
    half = (dof + d) / 2
    query = _level(query, *[f"_c{c} - {half}D * log1p(_d{c} / {dof}D) AS _l{c}" for c in comps])
    logs = [f"_l{c}" for c in comps]
    return _level(query, f"{f'greatest({", ".join(logs)})' if k > 1 else logs[0]} AS _top")


def _over_top(k: int) -> str:
    return " + ".join(f"exp(_l{c} - _top)" for c in range(k))


def _moments(names: list, k: int, dof: float) -> str:
    """Query for the sufficient statistics of one E-step; one row."""
    d = len(names)
    rows = _log_densities(f"{{points}} CROSS JOIN {PARAMETERS}", [*names, "_n"], names, k, dof, lambda name: name)
    rows = _level(rows, f"_top + ln({_over_top(k)}) AS _ll")
    # Responsibility of each component, and its robustness weight: small far from the centre.
    rows = _level(
        rows,
        *[f"exp(_l{c} - _ll) AS _r{c}" for c in range(k)],
        *[f"{dof + d}D / ({dof}D + _d{c}) AS _u{c}" for c in range(k)],
    )
    shares = ", ".join(f"_n * _r{c} AS _s{c}, _n * _r{c} * _u{c} AS _w{c}" for c in range(k))
    sums = ["sum(_n * _ll) AS ll"]
    for c in range(k):
        sums += [f"sum(_s{c}) AS s{c}", f"sum(_w{c}) AS w{c}"]
        sums += [f"sum(_w{c} * {x}) AS w{c}_{i}" for i, x in enumerate(names)]
        sums += [
            f"sum(_w{c} * {names[i]} * {names[j]}) AS w{c}_{i}_{j}" for i in range(d) for j in range(i, d)
        ]
    return f"SELECT {', '.join(sums)} FROM (SELECT *, {shares} FROM ({rows}))"


@dataclass(frozen=True)
class TMixtureModel:
    columns: tuple
    dof: float
    fitted: Parameters  # after the last M-step
    assigning: Parameters  # of the last E-step, which labels come from
    log_likelihood: float
    n_iter: int

    def assign(self, df: DataFrame, label: str, confidence: str) -> DataFrame:
        """Add the most responsible component (lowest on ties) and its responsibility."""
        k = self.assigning.k
        values = self.assigning.numbers(self.dof)
        names = [f"_x{i}" for i in range(len(self.columns))]
        rows = df.withColumns({x: F.col(c).cast("double") for x, c in zip(names, self.columns)})
        query = _log_densities("{rows}", rows.columns, names, k, self.dof, lambda name: f"({values[name]!r}D)")
        scored = df.sparkSession.sql(query, rows=rows)
        pick = F
        for c in range(k):
            pick = pick.when(F.col(f"_l{c}") == F.col("_top"), F.lit(c))
        # The greatest responsibility, exp(_top - log-likelihood), in one step.
        share = F.expr(f"1.0D / ({_over_top(k)})")
        return scored.select(*df.columns, pick.alias(label), share.alias(confidence))


def _numbers(values) -> str:
    """A literal array of doubles, or of arrays of them."""
    inner = ", ".join(f"{float(v)!r}D" if np.isscalar(v) else _numbers(v) for v in values)
    return f"array({inner})"


def _squared(names: list, centre: str) -> str:
    """Squared distance from an array ``centre``, in billionths, so that ties do not
    depend on the order in which sums were added."""
    terms = " + ".join(f"({x} - {centre}[{i}]) * ({x} - {centre}[{i}])" for i, x in enumerate(names))
    return f"floor(({terms}) * 1e9D + 0.5D)"


def spread_points(points: DataFrame, names: list, most: int, total: float) -> list:
    """Points of which each lies farthest from those before it; the first is the one nearest to the mean.

    Ties go to the least values. Where there are fewer distinct points, the least one repeats.
    """
    sums = points.agg(*[F.sum(F.col("_n") * F.col(x)).alias(x) for x in names]).first()
    value = ", ".join(names)
    near = F.expr(f"min(struct({_squared(names, _numbers([s / total for s in sums]))} AS d, {value}))")
    chosen = [list(points.agg(near.alias("p")).first()["p"])[1:]]
    while len(chosen) < most:
        gap = f"array_min(transform({_numbers(chosen)}, c -> {_squared(names, 'c')}))"
        far = F.expr(f"min(struct(-{gap} AS d, {value}))")
        chosen.append(list(points.agg(far.alias("p")).first()["p"])[1:])
    return chosen


def _nearest(names: list, k: int, centres: str) -> str:
    """Number of the nearest centre, the lowest of equals."""
    gaps = f"transform({centres}, c -> {_squared(names, 'c')})"
    return f"CAST(array_position({gaps}, array_min({gaps})) AS INT) - 1"


def lloyd(points: DataFrame, names: list, starts: list, rounds: int) -> tuple[np.ndarray, float]:
    """Centres of the least sum of squares that k-means reaches from any of ``starts``.

    All restarts that still move take one step in one aggregation. A centre that
    loses all its points keeps its place.
    """
    k, d = len(starts[0]), len(names)
    centres = np.array(starts, float)
    costs, moving = np.full(len(starts), math.inf), list(range(len(starts)))
    for _ in range(max(1, rounds)):
        states = ", ".join(f"struct({r} AS r, {_numbers(centres[r])} AS m)" for r in moving)
        each = points.select(*names, "_n", F.expr(f"explode(array({states}))").alias("_s"))
        labelled = each.withColumn("_c", F.expr(_nearest(names, k, "_s.m")))
        gap = " + ".join(f"({x} - _s.m[_c][{i}]) * ({x} - _s.m[_c][{i}])" for i, x in enumerate(names))
        sums = labelled.groupBy("_s.r", "_c").agg(
            F.sum("_n").alias("n"), F.expr(f"sum(_n * ({gap}))").alias("cost"),
            *[F.expr(f"sum(_n * {x})").alias(f"s{i}") for i, x in enumerate(names)],
        )
        moved = centres.copy()
        costs[moving] = 0.0
        for row in sums.collect():  # k rows for each restart
            moved[row["r"], row["_c"]] = [row[f"s{i}"] / row["n"] for i in range(d)]
            costs[row["r"]] += row["cost"]
        shift = np.abs(moved - centres).max(axis=(1, 2))
        centres, moving = moved, [r for r in moving if shift[r] > 1e-9]
        if not moving:
            break
    best = int(np.argmin(np.floor(costs * 1e6 + 0.5)))
    return centres[best], float(costs[best])


def _start(points: DataFrame, columns: list, k: int, reg: float, total: float, cfg: Config) -> Parameters:
    """K-means centres with each group's sample covariance and share; they depend on the points only."""
    d = len(columns)
    chosen = spread_points(points, columns, k + (cfg.kmeans_restarts - 1 if k > 1 else 0), total)
    restarts = [chosen[r : r + k] for r in range(len(chosen) - k + 1)]
    centres, _ = lloyd(points, columns, restarts, cfg.kmeans_iterations)
    grouped = points.withColumn("_group", F.expr(_nearest(columns, k, _numbers(centres))))

    n = F.col("_n")
    sums = [F.sum(n).alias("n")]
    sums += [F.sum(n * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)]
    centred = grouped.groupBy("_group").agg(*sums)
    groups = {row["_group"]: row for row in centred.collect()}  # k rows
    means = centres.copy()
    members = np.zeros(k)
    for c, row in groups.items():
        members[c] = row["n"]
        means[c] = [row[f"s{i}"] / row["n"] for i in range(d)]

    centre = [
        reduce(lambda acc, c: acc.when(F.col("_group") == c, lit_double(means[c, i])), range(k), F)
        for i in range(d)
    ]
    gaps = grouped.select("_group", "_n", *[(F.col(c) - centre[i]).alias(f"g{i}") for i, c in enumerate(columns)])
    spreads = gaps.groupBy("_group").agg(
        *[
            F.sum(n * F.col(f"g{i}") * F.col(f"g{j}")).alias(f"s{i}_{j}")
            for i in range(d) for j in range(i, d)
        ]
    )
    covariances = np.array([np.eye(d)] * k)
    for row in spreads.collect():  # k rows
        c = row["_group"]
        if members[c] > 1:
            for i in range(d):
                for j in range(i, d):
                    covariances[c, i, j] = covariances[c, j, i] = row[f"s{i}_{j}"] / (members[c] - 1)
            covariances[c] += reg * np.eye(d)
    return Parameters(means, covariances, np.maximum(members, 1) / total)


def fit_t_mixture(
    df: DataFrame,
    columns: list,
    n_components: int | None = None,
    dof: float | None = None,
    weight: str | None = None,
    n_iter: int | None = None,
    tol: float | None = None,
    reg_covar: float | None = None,
    start: Parameters | None = None,
    cfg: Config = DEFAULT,
) -> TMixtureModel:
    """EM on ``columns`` of ``df``; ``weight`` counts how often a row occurs.

    Without ``start`` it begins with k-means groups, which depend on the points
    only, not on how they are partitioned.
    """
    k = cfg.severity_groups if n_components is None else n_components
    dof = cfg.dof if dof is None else dof
    n_iter = cfg.em_iterations if n_iter is None else n_iter
    tol = cfg.em_tolerance if tol is None else tol
    reg = cfg.em_regularisation if reg_covar is None else reg_covar
    d = len(columns)
    names = [f"x{i}" for i in range(d)]

    counted = F.sum(weight) if weight else F.count(F.lit(1))
    points = (
        df.groupBy(*[F.col(c).cast("double").alias(x) for c, x in zip(columns, names)])
        .agg(counted.cast("double").alias("_n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        total = points.agg(F.sum("_n")).first()[0]
        if not total:
            raise ValueError("a mixture needs at least one row")
        now = _start(points, names, k, reg, total, cfg) if start is None else start
        query = _moments(names, k, dof)
        previous = -math.inf
        used = 0
        assigning = now
        for used in range(1, n_iter + 1):
            assigning = now
            now, likelihood = _iterate(points, query, now, dof, reg, total)
            if abs(likelihood - previous) < tol * max(abs(previous), 1.0):
                break
            previous = likelihood
    finally:
        points.unpersist()
    return TMixtureModel(tuple(columns), dof, now, assigning, previous, used)


def _iterate(points: DataFrame, query: str, now: Parameters, dof: float, reg: float, total: float):
    """One EM step: the next parameters and the log-likelihood of the current ones."""
    k, d = now.k, now.d
    values = now.numbers(dof)
    numbers = ", ".join(f"{v!r}D" for v in values.values())
    parameters = f"(VALUES ({numbers})) AS parameters({', '.join(values)})"  # one row
    row = points.sparkSession.sql(query.replace(PARAMETERS, parameters), points=points).collect()[0]

    means = np.zeros((k, d))
    covariances = np.zeros((k, d, d))
    shares = np.array([row[f"s{c}"] + TINY for c in range(k)])
    for c in range(k):
        w = row[f"w{c}"] + TINY
        first = np.array([row[f"w{c}_{i}"] for i in range(d)])
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = row[f"w{c}_{i}_{j}"]
        means[c] = first / w
        covariances[c] = (second - np.outer(first, first) / w) / shares[c] + reg * np.eye(d)
    return Parameters(means, covariances, shares / total), row["ll"]
