"""SQL for the severity mixture: spread-out starts, k-means and EM as recursive queries.

Written for three components over three columns; every number of a step is an
aggregate over the distinct profiles.
"""

from __future__ import annotations

import math

K, D, DOF, REG = 3, 3, 4.0, 1e-3
RESTARTS, ROUNDS, STEPS, TOLERANCE = 10, 300, 100, 1e-4
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
COLUMNS = ("mortality_rate", "symptom_severity", "number_affected")


def e(value: float) -> str:
    """A double literal."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


def _squared(centre: str) -> str:
    terms = " + ".join(f"(x{i} - {centre}[{i + 1}]) * (x{i} - {centre}[{i + 1}])" for i in range(D))
    return f"floor(({terms}) * 1e9 + 0.5e0)"


X = ", ".join(f"x{i}" for i in range(D))
POINTS = f"""
profiles AS MATERIALIZED (SELECT {', '.join(f'p{i}' for i in range(D))}, CAST(count(*) AS DOUBLE) AS n FROM (
  SELECT {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0e0) AS p{i}' for i, c in enumerate(COLUMNS))} FROM reports) GROUP BY ALL),
centred AS MATERIALIZED (SELECT sum(n) AS total, {', '.join(f'sum(n * p{i}) / sum(n) AS m{i}' for i in range(D))} FROM profiles),
spreads AS MATERIALIZED (SELECT any_value(total) AS total, {', '.join(f'any_value(m{i}) AS m{i}' for i in range(D))},
  {', '.join(f'coalesce(nullif(sqrt(sum(n * (p{i} - m{i}) * (p{i} - m{i})) / any_value(total)), 0e0), 1e0) AS d{i}' for i in range(D))}
  FROM profiles, centred),
pts AS MATERIALIZED (SELECT {', '.join(f'p{i}' for i in range(D))}, n, {', '.join(f'(p{i} - m{i}) / d{i} AS x{i}' for i in range(D))}
  FROM profiles, spreads)"""

FARTHEST = f"""
far AS (
  SELECT 1 AS step, [min([d, {X}])[2:{D + 1}]] AS chosen FROM (
    SELECT {_squared('c')} AS d, {X} FROM pts, (SELECT [{', '.join(f'sum(n * x{i}) / sum(n)' for i in range(D))}] AS c FROM pts))
  UNION ALL
  SELECT step + 1, list_append(any_value(chosen), min([-g, {X}])[2:{D + 1}]) FROM (
    SELECT step, chosen, {X}, list_min(list_transform(chosen, lambda c: {_squared('c')})) AS g
    FROM far, pts WHERE step < {K + RESTARTS - 1})
  GROUP BY step),
starts AS (SELECT r, chosen[r + 1 : r + {K}] AS c FROM far, range({RESTARTS}) t(r) WHERE step = {K + RESTARTS - 1})"""

_NEW = ", ".join(
    f"CASE WHEN count(*) FILTER (k = {c + 1}) = 0 THEN any_value(c)[{c + 1}] ELSE ["
    + ", ".join(f"sum(x{i} * n) FILTER (k = {c + 1}) / sum(n) FILTER (k = {c + 1})" for i in range(D)) + "] END"
    for c in range(K)
)
_SHIFT = "greatest(" + ", ".join(f"abs(c[{c}][{i}] - b[{c}][{i}])" for c in range(1, K + 1) for i in range(1, D + 1)) + ")"
LLOYD = f"""
lloyd AS (
  SELECT r, 0 AS round, c, TRUE AS moved, 0e0 AS cost FROM starts
  UNION ALL
  SELECT r, round + 1, c, {_SHIFT} > 1e-9 AS moved, cost FROM (
    SELECT r, round, [{_NEW}] AS c, any_value(c) AS b, sum(n * gap) AS cost FROM (
      SELECT *, {' + '.join(f'(x{i} - c[k][{i + 1}]) * (x{i} - c[k][{i + 1}])' for i in range(D))} AS gap FROM (
        SELECT *, list_position(gaps, list_min(gaps)) AS k FROM (
          SELECT r, round, c, {X}, n, list_transform(c, lambda m: {_squared('m')}) AS gaps
          FROM lloyd, pts WHERE moved AND round < {ROUNDS})))
    GROUP BY r, round)),
ended AS (SELECT r, arg_max(c, round) AS c, arg_max(cost, round) AS cost FROM lloyd GROUP BY r),
centres AS MATERIALIZED (SELECT c FROM ended ORDER BY floor(cost * 1e6 + 0.5e0), r LIMIT 1),
grouped AS MATERIALIZED (SELECT *, list_position(gaps, list_min(gaps)) AS k FROM (
  SELECT {X}, n, c, list_transform(c, lambda m: {_squared('m')}) AS gaps FROM centres, pts))"""

_GROUP_MEAN = ", ".join(
    f"coalesce(sum(n * x{i}) FILTER (k = {c + 1}) / sum(n) FILTER (k = {c + 1}), any_value(c)[{c + 1}][{i + 1}])"
    for c in range(K) for i in range(D)
)
_GROUP_SPREAD = ", ".join(
    f"CASE WHEN sum(n) FILTER (k = {c + 1}) > 1 THEN sum(n * (x{i} - m[{c * D + i + 1}]) * (x{j} - m[{c * D + j + 1}]))"
    f" FILTER (k = {c + 1}) / (sum(n) FILTER (k = {c + 1}) - 1e0) + {e(REG if i == j else 0)} ELSE {e(i == j)} END"
    for c in range(K) for i, j in PAIRS
)
_GROUP_SHARE = ", ".join(f"greatest(coalesce(sum(n) FILTER (k = {c + 1}), 0e0), 1e0) / sum(n)" for c in range(K))
START = f"""
group_means AS MATERIALIZED (SELECT [{_GROUP_MEAN}] AS m FROM grouped),
start AS MATERIALIZED (SELECT any_value(m) AS m, [{_GROUP_SPREAD}] AS s, [{_GROUP_SHARE}] AS w FROM grouped, group_means)"""


def _precision(c: int) -> list:
    """Determinant and inverse of a component's covariance, by cofactors."""
    s = {p: f"s[{c * len(PAIRS) + at + 1}]" for at, p in enumerate(PAIRS)}
    a, b, d, f, g, h = (s[p] for p in PAIRS)  # rows a b d, b f g, d g h
    det = f"({a} * ({f} * {h} - {g} * {g}) - {b} * ({b} * {h} - {g} * {d}) + {d} * ({b} * {g} - {f} * {d}))"
    cofactors = [
        f"({f} * {h} - {g} * {g})", f"({d} * {g} - {b} * {h})", f"({b} * {g} - {d} * {f})",
        f"({a} * {h} - {d} * {d})", f"({b} * {d} - {a} * {g})", f"({a} * {f} - {b} * {b})",
    ]
    return [f"{det} AS det{c}", *[f"{x} / {det} AS q{c}_{i}{j}" for x, (i, j) in zip(cofactors, PAIRS, strict=True)]]


CONSTANT = math.lgamma((DOF + D) / 2) - math.lgamma(DOF / 2) - D / 2 * math.log(DOF * math.pi)


def densities(state: str, keep: str, points: str = "pts") -> str:
    """Points with weighted log-densities ``l<c>``, distances ``d<c>`` and log-likelihood ``ll`` under a state."""
    gap = [[f"(x{i} - m[{c * D + i + 1}])" for i in range(D)] for c in range(K)]
    distance = [
        " + ".join(f"{gap[c][i]} * {gap[c][j]} * q{c}_{i}{j} * {e(1 if i == j else 2)}" for i, j in PAIRS) for c in range(K)
    ]
    inner = f"SELECT *, {', '.join(x for c in range(K) for x in _precision(c))} FROM {state}"
    inner = f"SELECT {keep}, {', '.join(f'det{c}' for c in range(K))}, w, {', '.join(f'{x} AS d{c}' for c, x in enumerate(distance))} FROM ({inner}), {points}"
    logs = [
        f"{e(CONSTANT)} - 0.5e0 * ln(det{c}) + ln(w[{c + 1}] + 1e-300) - {e((DOF + D) / 2)} * ln(1e0 + d{c} / {e(DOF)}) AS l{c}"
        for c in range(K)
    ]
    inner = f"SELECT *, {', '.join(logs)} FROM ({inner})"
    inner = f"SELECT *, greatest({', '.join(f'l{c}' for c in range(K))}) AS top FROM ({inner})"
    return f"SELECT *, top + ln({' + '.join(f'exp(l{c} - top)' for c in range(K))}) AS ll FROM ({inner})"


def _em() -> str:
    keep = f"step, prev, {X}, n"
    rows = densities("(SELECT * FROM em WHERE NOT done AND step < %d)" % STEPS, keep)
    shares = ", ".join(f"n * exp(l{c} - ll) AS r{c}, n * exp(l{c} - ll) * {e(DOF + D)} / ({e(DOF)} + d{c}) AS v{c}" for c in range(K))
    rows = f"SELECT *, {shares} FROM ({rows})"
    sums = [f"sum(r{c}) + 1e-300 AS r{c}, sum(v{c}) + 1e-300 AS v{c}" for c in range(K)]
    sums += [f"sum(v{c} * x{i}) AS f{c}_{i}" for c in range(K) for i in range(D)]
    sums += [f"sum(v{c} * x{i} * x{j}) AS q{c}_{i}{j}" for c in range(K) for i, j in PAIRS]
    rows = f"SELECT step, any_value(prev) AS prev, sum(n) AS total, sum(n * ll) AS ll, {', '.join(sums)} FROM ({rows}) GROUP BY step"
    means = ", ".join(f"f{c}_{i} / v{c}" for c in range(K) for i in range(D))
    spread = ", ".join(f"(q{c}_{i}{j} - f{c}_{i} * f{c}_{j} / v{c}) / r{c} + {e(REG if i == j else 0)}" for c in range(K) for i, j in PAIRS)
    rows = f"SELECT *, abs(ll - prev) < {e(TOLERANCE)} * greatest(abs(prev), 1e0) AS over FROM ({rows})"
    return (
        f"SELECT step + 1, [{means}], [{spread}], [{', '.join(f'r{c} / total' for c in range(K))}],"
        f" CASE WHEN over THEN prev ELSE ll END, over FROM ({rows})"
    )


EM = f"""
em AS (
  SELECT 0 AS step, m, s, w, -1e300 AS prev, FALSE AS done FROM start
  UNION ALL {_em()}),
fitted AS MATERIALIZED (SELECT * FROM em ORDER BY step DESC LIMIT 1),
assigning AS MATERIALIZED (SELECT * FROM em ORDER BY step DESC LIMIT 1 OFFSET 1)"""

_NAME = "CASE rank WHEN 0 THEN 'Mild' WHEN 1 THEN 'Moderate' ELSE 'Severe' END"
GROUPS = f"""
components AS (SELECT c, {', '.join(f'm[c * {D} + {i + 1}] AS z{i}' for i in range(D))}, w[c + 1] AS weight, prev, step
  FROM fitted, range({K}) t(c)),
groups AS MATERIALIZED (SELECT *, {_NAME} AS name FROM (
  SELECT CAST(c AS INTEGER) AS c, weight, {', '.join(f'z{i} * d{i} + m{i} AS c{i}' for i in range(D))},
    CAST(row_number() OVER (ORDER BY {' + '.join(f'z{i}' for i in range(D))}, c) - 1 AS INTEGER) AS rank FROM components, spreads)),
graded_profiles AS MATERIALIZED (
  SELECT p0, p1, p2, c AS severity_group_raw, rank AS severity_group_rank,
    round_even(exp(top - ll) * 1000e0, 0) / 1000e0 AS severity_confidence, name AS severity_group
  FROM (SELECT *, CASE {' '.join(f'WHEN l{c} = top THEN {c}' for c in range(K))} END AS label FROM (
    {densities('assigning', 'p0, p1, p2')})) JOIN groups ON label = c)"""

MIXTURE = (POINTS, FARTHEST, LLOYD, START, EM)
SEVERITY = (*MIXTURE, GROUPS)
SAME_PROFILE = " AND ".join(f"coalesce(CAST(r.{c} AS DOUBLE), 0e0) = p{i}" for i, c in enumerate(COLUMNS))


def six(x: str) -> str:
    """A number to six places."""
    return f"floor({x} * 1e6 + 0.5e0) / 1e6"


FITTED_QUERY = f"""
, components AS (SELECT c, {', '.join(f'm[c * {D} + {i + 1}] AS z{i}' for i in range(D))}, w[c + 1] AS weight, prev, step
  FROM fitted, range({K}) t(c))
SELECT CAST(c AS INTEGER) AS component, {six('weight')} AS weight, {', '.join(f'{six(f"z{i}")} AS mean_{c}' for i, c in enumerate(COLUMNS))},
  floor(prev * 1e3 + 0.5e0) / 1e3 AS log_likelihood, CAST(step AS INTEGER) AS n_iter FROM components"""
ASSIGN_QUERY = f"""SELECT r.report_id, severity_group_raw, severity_group_rank, severity_confidence, severity_group
  FROM reports r JOIN graded_profiles ON {SAME_PROFILE}"""
GROUPS_QUERY = f"""SELECT {', '.join(f'{six(f"c{i}")} AS {c}' for i, c in enumerate(COLUMNS))}, c AS raw_component, rank, name,
  {six('weight')} AS mixture_weight FROM groups"""
RANK_QUERY = "SELECT c AS raw_component, rank FROM groups"
GRADED = f"""
graded AS (SELECT r.*, severity_group AS grade, severity_confidence AS sure FROM clustered r JOIN graded_profiles ON {SAME_PROFILE}
  WHERE st_cluster >= 0)"""
