"""The queries of the catalog as SQL over the given tables.

Written from the definitions, with direct windows, joins and a recursive query,
and with values of its own: nothing is imported from the engine. Only the rounding
of halves (:func:`rounded`) uses the same published splitting of a double into
exact parts as the engine does.
"""

from __future__ import annotations

from catalog import mixture_sql

# Vocabulary, weights and wordings that results are compared in.
SPECIES = ("cattle", "buffalo", "goat", "sheep", "poultry")
SYMPTOM_WEIGHTS = {
    "fever": 1,
    "coughing": 1,
    "nasal_discharge": 1,
    "weakness": 1,
    "diarrhea": 2,
    "loss_of_appetite": 2,
    "reduced_milk_production": 2,
    "skin_lesions": 3,
    "swelling": 3,
    "respiratory_distress": 4,
    "neurological_symptoms": 5,
    "sudden_death": 5,
}
ACTIONS = {
    "LOW": "Log for routine monitoring. No immediate action required.",
    "MEDIUM": "Notify the local veterinary worker for a follow-up visit within a few days.",
    "HIGH": "Escalate for urgent veterinary assessment and consider sample collection.",
}
RULE_CRITICAL = (
    "Neurological symptoms or sudden death reported - treated as an "
    "automatic high-concern signal regardless of other factors."
)
REGION_NONE = "No single factor dominates - risk is low across all components."
SCALE_EPIDEMIC = "Epidemic-scale (multi-village/district)"
SCALE_LOCAL = "Localized outbreak"
COLORS = {"LOW": "#2e7d32", "MEDIUM": "#f9a825", "HIGH": "#ef6c00", "CRITICAL": "#c62828"}
BADGES = {"LOW": "\U0001F7E2", "MEDIUM": "\U0001F7E1", "HIGH": "\U0001F7E0", "CRITICAL": "\U0001F534"}

SPECIES_SQL = ", ".join(f"'{s}'" for s in SPECIES)
FLAGS = [f"symptom_{s}" for s in SYMPTOM_WEIGHTS]
COUNT = " + ".join(f"CAST({f} AS INTEGER)" for f in FLAGS)
SEVERITY = " + ".join(f"CAST(symptom_{s} AS INTEGER) * {w}" for s, w in SYMPTOM_WEIGHTS.items())
CRITICAL = "(symptom_neurological_symptoms OR symptom_sudden_death)"
MIN_SAMPLES = 40


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rounded(x: str, n: int) -> str:
    """Round half-even on the stored binary value of column ``x``."""
    p = f"{10**n}e0"
    s = f"({x} * {p})"
    high = f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    error = f"(({high} * {p} - {s}) + ({x} - {high}) * {p})"
    return (
        f"(CASE WHEN {s} - floor({s}) = 0.5e0 THEN"
        f" CASE WHEN {error} > 0 THEN floor({s}) + 1e0 WHEN {error} < 0 THEN floor({s})"
        f" ELSE floor({s}) + CAST(CAST(floor({s}) AS BIGINT) % 2 AS DOUBLE) END"
        f" ELSE round_even({s}, 0) END / {p})"
    )


def percent(x: str, n: int = 0) -> str:
    return f"printf('%.{n}f%%', {rounded(f'({x} * 100e0)', n)})"


def rate(a: str, b: str, other: str = "0e0") -> str:
    return f"CASE WHEN {b} = 0 THEN {other} ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


REPORTS = f"""
raw AS (
  SELECT event_id AS report_id, CAST(ts AS DATE) AS date, r_name AS district, n_name AS block,
    'V' || CAST(user_id AS VARCHAR) AS village, user_id AS u,
    CASE event_type WHEN 'click' THEN 'cattle' WHEN 'error' THEN 'buffalo' WHEN 'purchase' THEN 'goat'
      WHEN 'signup' THEN 'sheep' WHEN 'view' THEN 'poultry' END AS species,
    CAST(1 + k % 20 AS INTEGER) AS number_affected,
    CAST(least(1 + k % 20, floor(value / 60e0)) AS INTEGER) AS number_deaths,
    CAST(1 + k % 9 AS INTEGER) AS duration_days,
    CASE WHEN event_id % 10 >= 3 THEN 37.6e0 + (k % 39) / 10e0 END AS temperature,
    '' AS notes,
    event_id % 3 = 0 AS symptom_fever, (event_id + 1) % 4 = 0 AS symptom_coughing,
    (event_id + 2) % 5 = 0 AS symptom_nasal_discharge, (event_id + 3) % 4 = 0 AS symptom_weakness,
    (event_id + 1) % 7 = 0 AS symptom_diarrhea, (event_id + k) % 5 = 0 AS symptom_loss_of_appetite,
    (event_id + k) % 7 = 0 AS symptom_reduced_milk_production, (event_id + 3) % 12 = 0 AS symptom_skin_lesions,
    (event_id + k) % 13 = 0 AS symptom_swelling, (event_id + 5) % 17 = 0 AS symptom_respiratory_distress,
    (event_id + 7) % 50 = 0 AS symptom_neurological_symptoms, (event_id + k) % 53 = 0 AS symptom_sudden_death
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
  JOIN nation ON n_nationkey = user_id % 25 JOIN region ON n_regionkey = r_regionkey),
weighed AS (
  SELECT *, CAST(number_deaths AS DOUBLE) / CAST(number_affected AS DOUBLE) AS mortality_rate,
    {COUNT} AS symptom_count, {SEVERITY} AS symptom_severity FROM raw),
reports AS (
  SELECT * EXCLUDE (concern), CASE WHEN concern <= 0.28e0 THEN 'LOW' WHEN concern <= 0.48e0 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level
  FROM (SELECT *, 0.35e0 * greatest(0e0, least(1e0, mortality_rate / 0.5e0))
      + 0.25e0 * (CAST(symptom_severity AS DOUBLE) / 30e0)
      + 0.20e0 * greatest(0e0, least(1e0, CAST(number_affected AS DOUBLE) / 20e0))
      + 0.20e0 * CAST({CRITICAL} AS DOUBLE) AS concern FROM weighed))"""

REGIONS = """
regions AS (
  SELECT DISTINCT district, block, village,
    16e0 + 0.2e0 * CAST(u % 25 AS DOUBLE) + 0.0095e0 * CAST(u // 25 AS DOUBLE) AS latitude,
    73e0 + 0.25e0 * CAST(u % 25 AS DOUBLE) AS longitude, u FROM reports)"""

GAPPY = """
gappy AS (SELECT * REPLACE (CASE WHEN u % 5 <> 0 THEN latitude END AS latitude) FROM regions)"""

TABLE_COLUMNS = ", ".join(
    ["report_id", "date", "district", "block", "village", "species", "number_affected", "number_deaths",
     "duration_days", "temperature", "CAST(NULL AS VARCHAR) AS notes", *FLAGS, "mortality_rate", "risk_level"]
)


def q(body: str, *ctes: str) -> str:
    """A query over the derived reports; a body may start with further ``, name AS``."""
    return f"WITH RECURSIVE {', '.join([REPORTS, *ctes])} {body}"


# --- rollup and score -------------------------------------------------------
def rollup(region: str, source: str = "reports", as_of: str | None = None) -> str:
    as_of = f"DATE '{as_of}'" if as_of else f"(SELECT max(date) FROM {source})"
    return f"""
aged AS (SELECT *, date_diff('day', date, {as_of}) AS age FROM {source}),
sums AS (
  SELECT {region} AS region, count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS c7,
    count(*) FILTER (WHERE age BETWEEN 0 AND 29) AS c30, count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS prev,
    CAST(coalesce(sum(number_affected) FILTER (WHERE age BETWEEN 0 AND 6), 0) AS BIGINT) AS affected,
    CAST(coalesce(sum(number_deaths) FILTER (WHERE age BETWEEN 0 AND 6), 0) AS BIGINT) AS dead,
    count(*) FILTER (WHERE age BETWEEN 0 AND 6 AND risk_level = 'HIGH') AS high,
    count(*) FILTER (WHERE age > 0 AND risk_level = 'HIGH') AS hist
  FROM aged GROUP BY 1),
rates AS (SELECT *, {rate('dead', 'affected')} AS m, {rate('high', 'c7')} AS h,
    {rate('c7', 'prev', 'CAST(c7 AS DOUBLE)')} AS g FROM sums),
rollup AS (
  SELECT region, c7 AS report_count_7d, c30 AS report_count_30d, affected AS affected_animals, dead AS deaths,
    {rounded('m', 4)} AS mortality_rate, high AS high_concern_count, {rounded('h', 4)} AS high_concern_ratio,
    {rounded('g', 4)} AS report_growth_rate, hist AS historical_incidence FROM rates)"""


def capped(x: str, cap: str) -> str:
    return f"greatest(0e0, least(100e0, CAST({x} AS DOUBLE) / {cap} * 100e0))"


SCORED = f"""
parts AS (
  SELECT *, {capped('report_count_7d', '20e0')} AS p1, {capped('greatest(0e0, report_growth_rate - 1e0)', '3e0')} AS p2,
    {capped('mortality_rate', '0.5e0')} AS p3, {capped('high_concern_ratio', '1e0')} AS p4,
    {capped('historical_incidence', '10e0')} AS p5 FROM rollup),
totals AS (SELECT *, greatest(0e0, least(100e0,
    0.25e0 * p1 + 0.2e0 * p2 + 0.2e0 * p3 + 0.2e0 * p4 + 0.15e0 * p5)) AS t FROM parts),
finals AS (SELECT *, {rounded('t', 1)} AS risk_score FROM totals),
risk AS (
  SELECT region, report_count_7d, report_count_30d, affected_animals, deaths, mortality_rate, high_concern_count,
    high_concern_ratio, report_growth_rate, historical_incidence, risk_score,
    CASE WHEN risk_score < 30 THEN 'LOW' WHEN risk_score < 60 THEN 'MEDIUM' WHEN risk_score < 80 THEN 'HIGH'
      ELSE 'CRITICAL' END AS risk_category,
    {rounded('p1', 1)} AS sub_score_volume, {rounded('p2', 1)} AS sub_score_growth,
    {rounded('p3', 1)} AS sub_score_mortality, {rounded('p4', 1)} AS sub_score_high_concern,
    {rounded('p5', 1)} AS sub_score_historical FROM finals)"""


def risk(region: str, body: str | None = None, source: str = "reports", as_of: str | None = None, *ctes: str) -> str:
    body = body or f"SELECT region AS {region}, * EXCLUDE (region) FROM risk"
    return q(body, *ctes, rollup(region, source, as_of), SCORED)


def case_map(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items()) + " END"


REGION_REASONS = f"""
named AS (
  SELECT region, concat_ws(' | ',
    CASE WHEN sub_score_mortality >= 40 THEN 'Elevated mortality rate (' || {percent('mortality_rate')} || ' over the last 7 days)' END,
    CASE WHEN sub_score_growth >= 30 THEN 'Reports growing quickly (7-day growth ratio ' || printf('%.2f', {rounded('report_growth_rate', 2)}) || 'x)' END,
    CASE WHEN sub_score_volume >= 40 THEN printf('High report volume (%d reports in 7 days)', report_count_7d) END,
    CASE WHEN sub_score_high_concern >= 30 THEN 'Large share of HIGH-concern reports (' || {percent('high_concern_ratio')} || ')' END,
    CASE WHEN sub_score_historical >= 30 THEN printf('History of past outbreaks (%d prior HIGH reports)', historical_incidence) END
  ) AS found FROM risk)"""

MARKER = f"""SELECT region AS village, block, district, latitude, longitude, risk_score, risk_category,
  {case_map('risk_category', COLORS)} AS color, 6e0 + least(14e0, risk_score / 6e0) AS radius,
  region || ' - ' || risk_category AS tooltip, block || ', ' || district AS place_text,
  printf('%.0f', round_even(risk_score, 0)) || '/100' AS score_text, report_count_7d, affected_animals, deaths,
  {percent('mortality_rate', 1)} AS mortality_text, high_concern_count,
  printf('%.2f', {rounded('report_growth_rate', 2)}) || 'x' AS growth_text
  FROM risk JOIN gappy ON region = village WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""

RANKING = ("risk_score, risk_category, report_count_7d, report_count_30d, affected_animals, deaths, "
           "mortality_rate, high_concern_count, report_growth_rate, historical_incidence")


# --- context ----------------------------------------------------------------
CONTEXT = f"""
counted AS (
  SELECT *, count(*) OVER (w RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) - 1 AS recent_reports,
    count(*) OVER (w RANGE BETWEEN 13 PRECEDING AND 7 PRECEDING) AS recent_reports_prev,
    CAST(coalesce(sum(CAST(risk_level = 'HIGH' AS INTEGER)) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS historical_incidence,
    count(*) OVER (w RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) - 1 >= 3 AS rapid_spread
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) AS d FROM reports)
  WINDOW w AS (PARTITION BY village ORDER BY d)),
velocities AS (SELECT *, {rate('recent_reports', 'recent_reports_prev', 'CAST(recent_reports AS DOUBLE)')} AS v FROM counted),
context AS (SELECT *, {rounded('v', 3)} AS spread_velocity FROM velocities)"""

CONTEXT_LIST = "recent_reports, recent_reports_prev, historical_incidence, spread_velocity, rapid_spread"


def asked(targets: str, history: str, key: str = "report_id", extra: str = "TRUE") -> str:
    """Context of ``targets`` (key, village, date) against ``history``."""
    return f"""
matched AS (
  SELECT t.{key}, count(*) FILTER (WHERE a BETWEEN 0 AND 6) AS recent_reports,
    count(*) FILTER (WHERE a BETWEEN 7 AND 13) AS recent_reports_prev,
    count(*) FILTER (WHERE a > 0 AND level = 'HIGH') AS historical_incidence,
    count(*) FILTER (WHERE a BETWEEN 0 AND 2) >= 3 AS rapid_spread
  FROM {targets} t LEFT JOIN (
    SELECT t2.{key} AS id, date_diff('day', h.date, t2.date) AS a, h.risk_level AS level FROM {targets} t2
    JOIN {history} h ON h.village = t2.village AND ({extra})) ON id = t.{key}
  GROUP BY 1),
asked AS (SELECT * EXCLUDE (v), {rounded('v', 3)} AS spread_velocity FROM
  (SELECT *, {rate('recent_reports', 'recent_reports_prev', 'CAST(recent_reports AS DOUBLE)')} AS v FROM matched))"""


RULES = f"""
ruled AS (
  SELECT *, CASE WHEN number_deaths >= 3 AND number_affected >= 5 THEN 'multiple_deaths'
    WHEN {rate('number_deaths', 'number_affected')} >= 0.3e0 THEN 'high_mortality_rate'
    WHEN {CRITICAL} THEN 'critical_symptoms'
    WHEN symptom_respiratory_distress AND number_affected >= 3 THEN 'respiratory_cluster'
    WHEN rapid_spread THEN 'rapid_spread' END AS rule_name FROM context),
judged AS (
  SELECT *, rule_name IS NOT NULL AS rule_triggered, risk_level AS ml_prediction,
    CASE WHEN rule_name IS NOT NULL THEN 'HIGH' ELSE risk_level END AS final_risk,
    CASE rule_name
      WHEN 'multiple_deaths' THEN printf('%d deaths reported out of %d affected animals - meets the multiple-mortality emergency threshold.', number_deaths, number_affected)
      WHEN 'high_mortality_rate' THEN 'Mortality rate of ' || {percent('mortality_rate')} || ' exceeded the configured emergency threshold of 30%.'
      WHEN 'critical_symptoms' THEN {text(RULE_CRITICAL)}
      WHEN 'respiratory_cluster' THEN printf('Respiratory distress reported across %d animals, at or above the 3-animal cluster threshold.', number_affected)
      WHEN 'rapid_spread' THEN '3+ reports from this village within 3 days - flagged as a rapidly spreading situation.' END AS rule_explanation
  FROM ruled)"""

SYMPTOM_LIST = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN symptom_{s} THEN {text(s.replace('_', ' '))} END" for s in SYMPTOM_WEIGHTS
) + ")"

EXPLAIN = f"""SELECT report_id, concat_ws(' | ',
  CASE WHEN mortality_rate > 0 THEN printf('Mortality rate for this report: %s (%d of %d animals)', {percent('mortality_rate')}, number_deaths, number_affected) END,
  CASE WHEN symptom_count > 0 THEN 'Symptoms reported: ' || {SYMPTOM_LIST} END,
  CASE WHEN recent_reports > 0 THEN printf('%d other report(s) from this village in the last 7 days', recent_reports) END,
  CASE WHEN historical_incidence > 0 THEN printf('%d past HIGH-concern report(s) on record for this village', historical_incidence) END,
  printf('ML model classified this report as %s (confidence 100%%) based on the factors above', ml_prediction),
  CASE WHEN rule_triggered THEN 'Safety rule override triggered: ' || rule_explanation END) AS explanation FROM judged"""

CUT = "(SELECT max(date) - 1 FROM reports)"

# Later reports see earlier ones: history first, then new ones in date and id order.
ARRIVING = f"""
placed AS (
  SELECT *, date >= {CUT} AS is_new, row_number() OVER (PARTITION BY village, date ORDER BY report_id) - 1 AS same_day,
    date_diff('day', DATE '1970-01-01', date) AS d FROM reports),
seen AS (
  SELECT * EXCLUDE (d), d,
    count(*) OVER (w RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) + same_day AS recent_reports,
    count(*) OVER (w RANGE BETWEEN 13 PRECEDING AND 7 PRECEDING) AS recent_reports_prev,
    count(*) OVER (w RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) + same_day >= 3 AS rapid_spread
  FROM placed WINDOW w AS (PARTITION BY village ORDER BY d)),
arriving AS (
  SELECT *, CASE WHEN number_deaths >= 3 AND number_affected >= 5 THEN 'multiple_deaths'
    WHEN mortality_rate >= 0.3e0 THEN 'high_mortality_rate' WHEN {CRITICAL} THEN 'critical_symptoms'
    WHEN symptom_respiratory_distress AND number_affected >= 3 THEN 'respiratory_cluster'
    WHEN rapid_spread THEN 'rapid_spread' END AS rule_name FROM seen),
stored AS (SELECT * REPLACE (CASE WHEN is_new AND rule_name IS NOT NULL THEN 'HIGH' ELSE risk_level END AS risk_level) FROM arriving),
looked AS (
  SELECT *, CAST(coalesce(sum(CAST(risk_level = 'HIGH' AS INTEGER)) OVER
      (PARTITION BY village ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS historical_incidence,
    {rate('recent_reports', 'recent_reports_prev', 'CAST(recent_reports AS DOUBLE)')} AS v FROM stored),
accepted AS (
  SELECT (SELECT max(report_id) FROM reports WHERE date < {CUT}) + row_number() OVER (ORDER BY date, report_id) AS new_id,
    *, {rounded('v', 3)} AS spread_velocity, {rounded('mortality_rate', 4)} AS rate4 FROM looked WHERE is_new)"""

# Reports that arrive in any order: each sees the history and the new ones before it.
LATE = f"""
placed AS (
  SELECT *, date >= {CUT} AS is_new, CASE WHEN date >= {CUT} THEN (report_id * 1103515245 + 12345) % 2147483648 ELSE -1 END AS arrival FROM reports),
gaps AS (
  SELECT t.report_id, h.report_id AS other, date_diff('day', h.date, t.date) AS a
  FROM placed t JOIN placed h ON h.village = t.village AND h.arrival < t.arrival WHERE t.is_new),
seen AS (
  SELECT placed.*, coalesce(c.recent, 0) AS recent_reports, coalesce(c.prev, 0) AS recent_reports_prev, coalesce(c.rapid, 0) >= 3 AS rapid_spread
  FROM placed LEFT JOIN (
    SELECT report_id, count(*) FILTER (WHERE a BETWEEN 0 AND 6) AS recent, count(*) FILTER (WHERE a BETWEEN 7 AND 13) AS prev,
      count(*) FILTER (WHERE a BETWEEN 0 AND 2) AS rapid FROM gaps GROUP BY 1) c USING (report_id)),
arriving AS (
  SELECT *, CASE WHEN number_deaths >= 3 AND number_affected >= 5 THEN 'multiple_deaths'
    WHEN mortality_rate >= 0.3e0 THEN 'high_mortality_rate' WHEN {CRITICAL} THEN 'critical_symptoms'
    WHEN symptom_respiratory_distress AND number_affected >= 3 THEN 'respiratory_cluster'
    WHEN rapid_spread THEN 'rapid_spread' END AS rule_name FROM seen),
stored AS (SELECT * REPLACE (CASE WHEN is_new AND rule_name IS NOT NULL THEN 'HIGH' ELSE risk_level END AS risk_level) FROM arriving),
past AS (SELECT g.report_id, count(*) AS n FROM gaps g JOIN stored s ON s.report_id = g.other WHERE g.a > 0 AND s.risk_level = 'HIGH' GROUP BY 1),
looked AS (
  SELECT stored.*, coalesce(past.n, 0) AS historical_incidence,
    {rate('recent_reports', 'recent_reports_prev', 'CAST(recent_reports AS DOUBLE)')} AS v FROM stored LEFT JOIN past USING (report_id)),
accepted AS (
  SELECT (SELECT max(report_id) FROM reports WHERE date < {CUT}) + row_number() OVER (ORDER BY arrival) AS new_id,
    *, {rounded('v', 3)} AS spread_velocity, {rounded('mortality_rate', 4)} AS rate4 FROM looked WHERE is_new)"""

# Batch triage: new reports do not see each other.
BATCH = f"""
history AS (SELECT * FROM reports WHERE date < {CUT}),
fresh AS (SELECT * FROM reports WHERE date >= {CUT})"""

# --- clusters ---------------------------------------------------------------
CELLS = """
located AS (SELECT reports.*, latitude, longitude, date_diff('day', (SELECT min(date) FROM reports), date) AS day_offset
  FROM reports JOIN regions USING (village)),
cells AS (SELECT latitude, longitude, day_offset, count(*) AS weight, min(report_id) AS id FROM located GROUP BY ALL),
places AS (SELECT DISTINCT latitude, longitude FROM cells),
close AS (
  SELECT a.latitude AS lat_a, a.longitude AS lon_a, b.latitude AS lat_b, b.longitude AS lon_b FROM places a, places b
  WHERE 2 * 6371.0088e0 * asin(sqrt(least(1e0, sin(radians(b.latitude - a.latitude) / 2) ^ 2
    + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin(radians(b.longitude - a.longitude) / 2) ^ 2))) <= 2e0),
near AS (
  SELECT a.id AS a, b.id AS b, b.weight FROM cells a JOIN close ON a.latitude = lat_a AND a.longitude = lon_a
  JOIN cells b ON b.latitude = lat_b AND b.longitude = lon_b AND abs(a.day_offset - b.day_offset) <= 2)"""

CLUSTERS = f"""
core AS (SELECT a AS id FROM near GROUP BY a HAVING sum(weight) >= {MIN_SAMPLES}),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core) AND a <> b),
reach AS (SELECT id, id AS label FROM core UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.id
  WHERE reach.label < links.b),
roots AS (SELECT id, min(label) AS root FROM reach GROUP BY id),
ranked AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS st_cluster FROM roots),
labels AS (
  SELECT id, st_cluster FROM ranked UNION ALL
  SELECT a, min(st_cluster) FROM near JOIN ranked ON b = ranked.id WHERE a NOT IN (SELECT id FROM core) GROUP BY a),
clustered AS (SELECT located.*, coalesce(st_cluster, -1) AS st_cluster FROM located
  JOIN cells USING (latitude, longitude, day_offset) LEFT JOIN labels ON labels.id = cells.id)"""

GRADED = """
graded AS (SELECT *, CASE risk_level WHEN 'LOW' THEN 'Mild' WHEN 'MEDIUM' THEN 'Moderate' ELSE 'Severe' END AS grade,
  round_even((1e0 - mortality_rate / 2e0) * 1000e0, 0) / 1000e0 AS sure FROM clustered WHERE st_cluster >= 0)"""

SUMMARY = f"""
grades AS (SELECT st_cluster, grade, count(*) AS n FROM graded GROUP BY ALL),
villages AS (SELECT st_cluster, village, count(*) AS n FROM graded GROUP BY ALL),
listed AS (SELECT st_cluster, string_agg(village, ', ' ORDER BY village) AS names FROM
  (SELECT *, row_number() OVER (PARTITION BY st_cluster ORDER BY village) AS r FROM villages) WHERE r <= 3 GROUP BY 1),
main AS (
  SELECT st_cluster, count(*) AS n_reports, count(DISTINCT village) AS n_villages, count(DISTINCT district) AS n_districts,
    min(date) AS date_start, max(date) AS date_end, CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS duration_days,
    CAST(sum(number_affected) AS BIGINT) AS total_affected, CAST(sum(number_deaths) AS BIGINT) AS total_deaths,
    CAST(sum(number_deaths) AS DOUBLE) / greatest(1, sum(number_affected)) AS m, CAST(sum(CAST(sure AS DECIMAL(18, 9))) AS DOUBLE) / count(*) AS c,
    count(*) FILTER (WHERE risk_level = 'HIGH') AS high_concern_reports FROM graded GROUP BY 1),
summary AS (
  SELECT st_cluster, n_reports, n_villages, n_districts, names || CASE WHEN n_villages > 3 THEN '...' ELSE '' END AS villages,
    (SELECT village FROM villages v WHERE v.st_cluster = main.st_cluster ORDER BY n DESC, village LIMIT 1) AS dominant_village,
    date_start, date_end, duration_days, total_affected, total_deaths, {rounded('m', 3)} AS mean_mortality_rate,
    high_concern_reports,
    (SELECT grade FROM grades g WHERE g.st_cluster = main.st_cluster ORDER BY n DESC, grade LIMIT 1) AS dominant_severity_group,
    {rounded('c', 3)} AS avg_severity_confidence,
    CASE WHEN (n_villages >= 2 OR n_districts >= 2) AND duration_days >= 7 THEN {text(SCALE_EPIDEMIC)} ELSE {text(SCALE_LOCAL)} END AS scale,
    total_deaths >= 18 AS flagged_as_outbreak FROM main JOIN listed USING (st_cluster)),
known AS (SELECT village FROM reports GROUP BY 1 HAVING sum(number_deaths) >= 24),
flagged AS (SELECT DISTINCT dominant_village AS village FROM summary WHERE flagged_as_outbreak)"""


def clu(body: str, *graded: str) -> str:
    return q(body, REGIONS, CELLS, CLUSTERS, *(graded or (GRADED,)), SUMMARY)


VALIDATE = clu(f"""SELECT n_known, n_flagged, true_positives, false_positives, false_negatives,
  {rounded('p', 3)} AS precision, {rounded('r', 3)} AS recall FROM (
  SELECT *, {rate('true_positives', '(true_positives + false_positives)')} AS p,
    {rate('true_positives', '(true_positives + false_negatives)')} AS r FROM (
    SELECT (SELECT count(*) FROM known) AS n_known, (SELECT count(*) FROM flagged) AS n_flagged,
      (SELECT count(*) FROM flagged WHERE village IN (FROM known)) AS true_positives,
      (SELECT count(*) FROM flagged WHERE village NOT IN (FROM known)) AS false_positives,
      (SELECT count(*) FROM known WHERE village NOT IN (FROM flagged)) AS false_negatives))""")

FLAGGED = clu("""SELECT st_cluster, dominant_village, n_reports, n_villages, date_start, date_end, duration_days, total_deaths,
  mean_mortality_rate, dominant_severity_group, scale FROM summary WHERE flagged_as_outbreak""")

# --- split, imputation, evaluation ------------------------------------------
SPLIT = """
drawn AS (SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY substr(md5(CAST(report_id AS VARCHAR) || '-42'), 1, 13), report_id) AS r,
  count(*) OVER (PARTITION BY risk_level) AS n FROM reports),
split AS (SELECT * EXCLUDE (r, n), r <= floor(0.8e0 * n + 0.5e0) AS is_train FROM drawn)"""

PLAIN = ["number_affected", "number_deaths", "mortality_rate", "duration_days", "temperature", "symptom_count", "symptom_severity"]
MEDIANS = "medians AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS median FROM split WHERE is_train"
    for c in [*PLAIN, *FLAGS]
) + ")"
ENCODED = "SELECT report_id, " + ", ".join(
    [f"coalesce(CAST({c} AS DOUBLE), (SELECT median FROM medians WHERE feature = '{c}')) AS slot_{c}" for c in [*PLAIN, *FLAGS]]
    + [f"0e0 AS slot_{c}" for c in ("recent_reports", "historical_incidence", "spread_velocity")]
    + [f"CAST(species = '{s}' AS DOUBLE) AS slot_species_{i}" for i, s in enumerate(sorted(SPECIES))]
) + " FROM split"

IMPORTANCE = "SELECT feature, TRUE AS is_share, TRUE AS sums_to_one FROM (VALUES " + ", ".join(
    f"('{c}')" for c in [
        *PLAIN, "recent_reports", "historical_incidence", "spread_velocity", *FLAGS, *[f"species_{s}" for s in SPECIES]
    ]
) + ") AS names(feature)"

GUESS = """
guess AS (SELECT risk_level AS actual, CASE WHEN number_deaths >= 3 THEN 'HIGH' WHEN symptom_severity >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS p FROM reports),
levels AS (SELECT * FROM (VALUES (0, 'LOW'), (1, 'MEDIUM'), (2, 'HIGH')) AS v(i, actual)),
confusion AS (SELECT i, levels.actual, count(*) FILTER (WHERE p = 'LOW') AS pred_LOW, count(*) FILTER (WHERE p = 'MEDIUM') AS pred_MEDIUM,
  count(*) FILTER (WHERE p = 'HIGH') AS pred_HIGH FROM levels LEFT JOIN guess USING (actual) GROUP BY ALL)"""
PER_CLASS = f"""
hits AS (SELECT i, actual AS label, pred_LOW + pred_MEDIUM + pred_HIGH AS support,
  CASE actual WHEN 'LOW' THEN pred_LOW WHEN 'MEDIUM' THEN pred_MEDIUM ELSE pred_HIGH END AS hit,
  (SELECT CAST(CASE c.actual WHEN 'LOW' THEN sum(pred_LOW) WHEN 'MEDIUM' THEN sum(pred_MEDIUM) ELSE sum(pred_HIGH) END AS BIGINT) FROM confusion) AS guessed
  FROM confusion c),
figures AS (SELECT *, {rate('hit', 'guessed')} AS precision, {rate('hit', 'support')} AS recall FROM hits),
per_class AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END AS f1 FROM figures)"""


def _macro(x: str) -> str:
    return f"((l.{x} + m.{x}) + h.{x}) / 3e0 AS {x}"


def _weighted(x: str) -> str:
    return f"((l.{x} * l.support + m.{x} * m.support) + h.{x} * h.support) / CAST(l.support + m.support + h.support AS DOUBLE) AS weighted_{x}"


DOUBTFUL = """
doubtful AS (SELECT * REPLACE (number_affected - 3 AS number_affected,
  CASE WHEN report_id % 11 = 0 THEN NULL WHEN report_id % 23 = 0 THEN -1 ELSE number_deaths * 2 END AS number_deaths,
  CASE WHEN report_id % 13 = 0 THEN 'dragon' ELSE species END AS species,
  CASE WHEN report_id % 17 = 0 THEN '' ELSE block END AS block,
  CASE WHEN report_id % 19 <> 0 THEN date END AS date) FROM reports),
checked AS (SELECT report_id, [x FOR x IN [
  CASE WHEN number_affected <= 0 THEN 'Number of affected animals must be a positive integer.' END,
  CASE WHEN number_deaths IS NULL OR number_deaths < 0 THEN 'Number of deaths cannot be negative.'
    WHEN number_affected <> 0 AND number_deaths > number_affected THEN 'Number of deaths cannot exceed the number of affected animals.' END,
  CASE WHEN species = 'dragon' THEN 'Species must be one of: cattle, buffalo, goat, sheep, poultry.' END,
  CASE WHEN block = '' THEN 'District, block and village are all required.' END,
  CASE WHEN date IS NULL THEN 'Report date is required.' END] IF x IS NOT NULL] AS errors FROM doubtful)"""

SHOWN = """
shown AS (SELECT * FROM reports WHERE district IN ('ASIA', 'EUROPE', 'AFRICA') AND species IN ('cattle', 'goat', 'poultry')
  AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24')"""

HISTOGRAM = risk("village", """, ends AS (SELECT min(risk_score) AS a, max(risk_score) AS b FROM risk),
counts AS (SELECT least(floor((risk_score - a) / (b - a) * 20e0), 19) AS bin, count(*) AS n FROM risk, ends GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, a + (b - a) * CAST(i AS DOUBLE) / 20e0 AS low, coalesce(n, 0) AS n
FROM range(20) t(i) CROSS JOIN ends LEFT JOIN counts ON bin = i""")


def _context_query(column: str) -> str:
    return q(f"SELECT report_id, {column} FROM context", CONTEXT)


def _level(level: str) -> str:
    return f"SELECT '{level}' AS level, {level} AS region, risk_score, risk_category, report_count_7d, deaths FROM ({risk(level)})"


def _z(x: str) -> str:
    z = f"(CAST({x} AS DOUBLE) - (SELECT avg({x}) FROM reports)) / (SELECT stddev_pop({x}) FROM reports)"
    return f"floor({z} * 1e6 + 0.5e0) / 1e6 AS z_{x}"


def all_oracles() -> dict:
    return {
        "src_reports": q(f"SELECT {TABLE_COLUMNS} FROM reports"),
        "src_regions": q("SELECT * EXCLUDE (u) FROM regions", REGIONS),
        "src_date_norm": q("SELECT report_id, date FROM reports"),
        "snk_tables": q("SELECT date, count(*) AS n, CAST(sum(number_affected) AS BIGINT) AS affected FROM reports GROUP BY 1"),
        "snk_append": q(
            f"""SELECT report_id, date, village, number_affected, mortality_rate, risk_level FROM history UNION ALL
            SELECT (SELECT max(report_id) FROM history) + row_number() OVER (ORDER BY date, report_id), date, village,
              number_affected, {rounded('mortality_rate', 4)}, final_risk FROM judged""",
            BATCH, asked("fresh", "history"),
            "context AS (SELECT * FROM fresh JOIN asked USING (report_id))", RULES),
        "proj_mortality": q(f"""SELECT report_id, mortality_rate AS rate, round_even(mortality_rate * 1000e0, 0) / 1000e0 AS rate_loaded,
            {rounded('mortality_rate', 4)} AS rate_appended FROM reports"""),
        "proj_symptoms": q("SELECT report_id, symptom_count, symptom_severity FROM reports"),
        "proj_features": q("""SELECT report_id, mortality_rate, symptom_count, symptom_severity, recent_reports,
            historical_incidence, spread_velocity, rapid_spread FROM context""", CONTEXT),
        "proj_feature_frame": q("SELECT report_id, " + ", ".join(
            [*PLAIN, "recent_reports", "historical_incidence", "spread_velocity"]
            + [f"CAST({f} AS INTEGER) AS {f}" for f in FLAGS] + ["species"]) + " FROM context", CONTEXT),
        "pred_validate": q("SELECT report_id, len(errors) = 0 AS valid, array_to_string(errors, ' | ') AS errors FROM checked", DOUBTFUL),
        "triage_rejected": q("SELECT report_id, CAST(len(errors) AS INTEGER) AS n_errors FROM checked WHERE len(errors) > 0", DOUBTFUL),
        "proj_defaults": q("""SELECT report_id, CASE WHEN report_id % 5 <> 0 THEN number_deaths ELSE 0 END AS number_deaths,
            CASE WHEN report_id % 3 <> 0 THEN duration_days ELSE 1 END AS duration_days, CAST(NULL AS DOUBLE) AS temperature,
            report_id % 7 <> 0 AND symptom_fever AS symptom_fever, FALSE AS symptom_swelling FROM reports"""),
        "pred_rules": q("SELECT report_id, rule_triggered, rule_name, rule_explanation FROM judged", CONTEXT, RULES),
        "proj_final_risk": q("SELECT report_id, ml_prediction, rule_triggered, final_risk FROM judged", CONTEXT, RULES),
        "proj_action": q(f"SELECT report_id, final_risk, {case_map('final_risk', ACTIONS)} AS recommended_action FROM judged", CONTEXT, RULES),
        "proj_explain_report": q(EXPLAIN, CONTEXT, RULES),
        "proj_explain_region": risk("village", f", {REGION_REASONS} SELECT region AS village, CASE WHEN found = '' THEN {text(REGION_NONE)} ELSE found END AS reasons FROM named"),
        "proj_normalize": risk("village", "SELECT region AS village, sub_score_volume, sub_score_growth, sub_score_mortality, sub_score_high_concern, sub_score_historical FROM risk"),
        "proj_score": risk("village", "SELECT region AS village, risk_score FROM risk"),
        "proj_category": risk("village", "SELECT region AS village, risk_category FROM risk"),
        "proj_day_offset": q("SELECT report_id, CAST(date_diff('day', (SELECT min(date) FROM reports), date) AS INTEGER) AS day_offset FROM reports"),
        "filt_dashboard": q("SELECT report_id, date, district, block, species FROM shown", SHOWN),
        "filt_risk_level": q("SELECT report_id, risk_level FROM reports WHERE risk_level IN ('MEDIUM', 'HIGH')"),
        "filt_coords": q("SELECT village, latitude, longitude FROM gappy WHERE latitude IS NOT NULL", REGIONS, GAPPY),
        "proj_label": q("SELECT report_id, risk_level FROM reports"),
        "proj_marker": risk("village", MARKER, "reports", None, REGIONS, GAPPY),
        "proj_badge": risk("village", f"SELECT {case_map('risk_category', BADGES)} AS badge, region AS village, {RANKING} FROM risk"),
        "join_risk_regions": risk("village", "SELECT village, risk_score, block, district, latitude, longitude FROM risk LEFT JOIN regions ON region = village", "reports", None, REGIONS),
        "join_report_coords": q("SELECT report_id, village, latitude, longitude FROM reports JOIN gappy USING (village) WHERE latitude IS NOT NULL", REGIONS, GAPPY),
        "join_context": q(f"SELECT report_id, {CONTEXT_LIST} FROM asked", BATCH, asked("fresh", "history")),
        "join_st_neighbors": q("""SELECT a AS first_report, day_offset, CAST(sum(near.weight) AS BIGINT) AS neighbours
            FROM near JOIN cells ON cells.id = a GROUP BY ALL""", REGIONS, CELLS),
        "semi_filter_lists": q("SELECT DISTINCT block FROM reports WHERE district IN ('ASIA', 'EUROPE', 'AFRICA')"),
        "join_validate_seed": VALIDATE,
        "agg_region_rollup": q("SELECT region AS village, * EXCLUDE (region) FROM rollup", rollup("village")),
        "agg_village_context": q(f"SELECT village, date, exclude_report_id, {CONTEXT_LIST} FROM asked JOIN targets USING (village)",
            "targets AS (SELECT village, max(date) AS date, max(report_id) AS exclude_report_id FROM reports GROUP BY 1)",
            asked("targets", "reports", "village", "h.report_id <> t2.exclude_report_id")),
        "risk_village": risk("village"),
        "risk_block": risk("block", None, "reports", "2024-01-28"),
        "risk_district": risk("district"),
        "risk_all_levels": " UNION ALL ".join(_level(x) for x in ("village", "block", "district")),
        "agg_kpi": risk("village", """SELECT (SELECT count(*) FROM shown) AS total_reports,
            (SELECT CAST(sum(number_affected) AS BIGINT) FROM shown) AS affected_animals,
            (SELECT CAST(sum(number_deaths) AS BIGINT) FROM shown) AS deaths,
            (SELECT count(*) FROM shown WHERE risk_level = 'HIGH') AS high_concern_reports,
            (SELECT count(*) FROM risk WHERE risk_category IN ('HIGH', 'CRITICAL')) AS high_risk_regions""", "shown", None, SHOWN),
        "agg_shown_of_total": q("SELECT (SELECT count(*) FROM shown) AS shown, count(*) AS total, (SELECT max(date) FROM shown) AS as_of FROM reports", SHOWN),
        "agg_date_bounds": q("SELECT min(date) AS min_date, max(date) AS max_date FROM reports"),
        "agg_daily_trend": q("SELECT date, count(*) AS reports, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_concern FROM reports GROUP BY 1"),
        "agg_cluster_summary": clu("SELECT * FROM summary"),
        "agg_cluster_totals": clu("SELECT count(DISTINCT st_cluster) FILTER (WHERE st_cluster >= 0) AS n_clusters_found, count(*) FILTER (WHERE st_cluster = -1) AS n_noise_reports FROM clustered"),
        "agg_class_balance": q("SELECT risk_level, count(*) AS n FROM reports GROUP BY 1"),
        "agg_score_histogram": HISTOGRAM,
        "agg_median_impute": q("SELECT feature, median FROM medians", SPLIT, MEDIANS),
        "agg_standardize": q(f"SELECT report_id, {_z('mortality_rate')}, {_z('symptom_severity')}, {_z('number_affected')} FROM reports"),
        "agg_class_weight": q("SELECT risk_level, n, CAST((SELECT count(*) FROM reports) AS DOUBLE) / CAST(3 * n AS DOUBLE) AS weight FROM (SELECT risk_level, count(*) AS n FROM reports GROUP BY 1)"),
        "agg_confusion": q("SELECT actual, pred_LOW, pred_MEDIUM, pred_HIGH FROM confusion", GUESS),
        "agg_class_metrics": q("SELECT label, precision, recall, f1, support FROM per_class", GUESS, PER_CLASS),
        "agg_metrics": q(f"""SELECT CAST(l.hit + m.hit + h.hit AS DOUBLE) / CAST(l.support + m.support + h.support AS DOUBLE) AS accuracy,
            {_macro('precision')}, {_macro('recall')}, {_macro('f1')}, h.recall AS high_recall,
            {_weighted('precision')}, {_weighted('recall')}, {_weighted('f1')}
            FROM per_class l, per_class m, per_class h WHERE l.label = 'LOW' AND m.label = 'MEDIUM' AND h.label = 'HIGH'""", GUESS, PER_CLASS),
        "win_recent_reports": _context_query("recent_reports"),
        "win_prev_reports": _context_query("recent_reports_prev"),
        "win_hist_incidence": _context_query("historical_incidence"),
        "win_spread_velocity": _context_query("spread_velocity"),
        "win_rapid_spread": _context_query("rapid_spread"),
        "win_context_all": q(f"SELECT report_id, village, date, {CONTEXT_LIST} FROM context", CONTEXT),
        "win_context_batch": q(f"SELECT report_id, {CONTEXT_LIST} FROM asked", asked("reports", "reports")),
        "win_cluster_id": clu("SELECT st_cluster, count(*) AS n, CAST(min(day_offset) AS INTEGER) AS first_day FROM clustered WHERE st_cluster >= 0 GROUP BY 1"),
        "win_stratified_split": q("SELECT report_id, risk_level, is_train FROM split", SPLIT),
        "sort_risk": risk("village", "SELECT region AS village, risk_score FROM risk ORDER BY risk_score DESC, region"),
        "topk_regions": risk("village", "SELECT region AS village, * EXCLUDE (region) FROM risk ORDER BY risk_score DESC, region LIMIT 5"),
        "topk_recent_reports": q("""SELECT date, district, block, village, species, number_affected, number_deaths, mortality_rate, risk_level, notes
            FROM shown WHERE risk_level IN ('MEDIUM', 'HIGH') ORDER BY date DESC, report_id DESC LIMIT 200""", SHOWN),
        "topk_recent_total": q("SELECT count(*) AS matching FROM shown WHERE risk_level IN ('MEDIUM', 'HIGH')", SHOWN),
        "sort_clusters": clu("SELECT st_cluster, flagged_as_outbreak, total_deaths, n_reports FROM summary"),
        "filt_flagged_clusters": FLAGGED,
        "sort_reports_renumber": q("SELECT row_number() OVER (ORDER BY date, 1000000000000 - report_id) AS report_id, date, village FROM reports"),
        "set_union_reports": q(f"""SELECT report_id, village, CASE WHEN date < {CUT} THEN mortality_rate END AS mortality_rate,
            CASE WHEN date < {CUT} THEN risk_level END AS risk_level FROM reports"""),
        "set_intersect_villages": clu("SELECT village FROM flagged INTERSECT SELECT village FROM known"),
        "set_except_villages": clu("""SELECT village, 'false alarm' AS side FROM (SELECT village FROM flagged EXCEPT SELECT village FROM known)
            UNION ALL SELECT village, 'missed' FROM (SELECT village FROM known EXCEPT SELECT village FROM flagged)"""),
        "set_distinct_options": q("SELECT DISTINCT village FROM reports"),
        "stream_triage": q(f"""SELECT new_id AS report_id, village, date, rate4 AS mortality_rate, risk_level, rule_name,
            {CONTEXT_LIST} FROM accepted""", ARRIVING),
        "stream_triage_late": q(f"""SELECT new_id AS report_id, village, date, rate4 AS mortality_rate, risk_level, rule_name,
            {CONTEXT_LIST} FROM accepted""", LATE),
        "stream_daily_trend": q("SELECT date, count(*) AS reports, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_concern FROM reports GROUP BY 1"),
        "stream_rapid_spread": q("""SELECT village, date, n FROM (SELECT village, date, count(*) AS n FROM
            (SELECT village, CAST(date + CAST(i AS INTEGER) AS DATE) AS date FROM reports, range(3) t(i)) GROUP BY ALL) WHERE n >= 4"""),
        "ml_preprocess": q(ENCODED, SPLIT, MEDIANS),
        "clu_st_dbscan": clu("SELECT report_id, st_cluster FROM clustered"),
        "snk_model": q("SELECT report_id, TRUE AS agrees FROM reports"),
        "src_model": q("SELECT report_id, TRUE AS agrees, TRUE AS absence_reported FROM reports"),
        "ml_train": q(
            "SELECT risk_level AS label, count(*) FILTER (WHERE NOT is_train) AS support, TRUE AS accuracy_follows,"
            " TRUE AS better_than_half FROM split GROUP BY 1", SPLIT
        ),
        "ml_evaluate_saved": q("SELECT risk_level AS actual, count(*) FILTER (WHERE NOT is_train) AS n FROM split GROUP BY 1", SPLIT),
        "ml_importance": IMPORTANCE,
        "topk_importance": "SELECT CAST(10 AS BIGINT) AS n, TRUE AS above_the_rest",
        "clu_detect": clu("SELECT * FROM summary", *mixture_sql.SEVERITY, mixture_sql.GRADED),
        "clu_t_mixture": q(mixture_sql.FITTED_QUERY, *mixture_sql.MIXTURE),
        "clu_severity_assign": q(mixture_sql.ASSIGN_QUERY, *mixture_sql.SEVERITY),
        "clu_severity_summary": q(mixture_sql.GROUPS_QUERY, *mixture_sql.SEVERITY),
        "win_severity_rank": q(mixture_sql.RANK_QUERY, *mixture_sql.SEVERITY),
        "sort_severity_groups": q(mixture_sql.GROUPS_QUERY, *mixture_sql.SEVERITY),
        "clu_validate": VALIDATE,
        "clu_report": FLAGGED,
    }
