from datetime import date

import pytest
from pyspark.sql import functions as F

from herdlens.operators import risk


def _score(make_reports, rows, as_of, level="village"):
    return {r[level]: r for r in risk.region_risk(make_reports(rows), level, as_of).collect()}


def test_region_without_recent_reports_scores_zero(make_reports):
    got = _score(make_reports, [{"date": date(2025, 5, 6), "number_affected": 4}], "2025-08-20")
    assert (got["A"].risk_score, got["A"].risk_category, got["A"].report_count_30d) == (0.0, "LOW", 0)


def test_deaths_and_concern_raise_the_score(make_reports):
    rows = [
        {"village": "calm", "number_affected": 16},
        {"village": "grave", "number_affected": 16, "number_deaths": 8, "risk_level": "HIGH"},
    ]
    got = _score(make_reports, rows, "2026-01-05")
    assert got["grave"].risk_score > got["calm"].risk_score
    # Halfway between two tenths: goes to the even one.
    assert (got["grave"].risk_score, got["grave"].risk_category) == (41.2, "MEDIUM")


def test_sudden_growth_raises_the_score(make_reports):
    steady = [{"village": "steady", "date": date(2025, 11, d)} for d in (3, 9, 12, 19, 24)]
    sudden = [{"village": "sudden", "date": date(2025, 11, d)} for d in (21, 22, 22, 23, 24)]
    got = _score(make_reports, steady + sudden, "2025-11-24")
    assert got["sudden"].sub_score_growth > got["steady"].sub_score_growth
    assert got["sudden"].risk_score > got["steady"].risk_score


def test_block_and_district_levels(make_reports):
    rows = [
        {"village": "A", "block": "B1", "number_deaths": 1, "risk_level": "HIGH"},
        {"village": "C", "block": "B2", "number_affected": 3},
        {"village": None, "block": None, "district": None},
    ]
    assert set(_score(make_reports, rows, "2026-01-05", "block")) == {"B1", "B2"}
    assert set(_score(make_reports, rows, "2026-01-05", "district")) == {"D1"}
    assert set(_score(make_reports, rows, None)) == {"A", "C"}


def test_all_levels_equal_single_levels(make_reports):
    rows = [
        {"village": v, "block": b, "number_deaths": i % 2, "date": date(2026, 1, 1 + i), "risk_level": "HIGH" if i % 3 else "LOW"}
        for i, (v, b) in enumerate([("A", "B1"), ("C", "B2"), ("A", "B1"), ("E", "B2"), ("C", "B2")] * 3)
    ]
    reports = make_reports(rows)
    for level, scored in risk.all_levels(reports).items():
        assert sorted(scored.collect()) == sorted(risk.region_risk(reports, level).collect())


def test_empty_input_keeps_the_schema(make_reports):
    empty = risk.region_risk(make_reports([]), "village")
    assert empty.count() == 0 and "sub_score_growth" in empty.columns


@pytest.mark.parametrize(
    "score,category",
    [(0, "LOW"), (29.9, "LOW"), (30, "MEDIUM"), (59.9, "MEDIUM"), (60, "HIGH"), (79.9, "HIGH"), (80, "CRITICAL"), (100, "CRITICAL"), (150, "CRITICAL")],
)
def test_category_edges(spark, score, category):
    assert spark.range(1).select(risk.risk_category(F.lit(float(score)))).first()[0] == category


def test_reasons(make_reports):
    quiet = risk.with_region_reasons(risk.region_risk(make_reports([{}]), "village")).first()
    assert quiet.reasons == ["No single factor dominates - risk is low across all components."]
    rows = [{"number_affected": 10, "number_deaths": 4, "risk_level": "HIGH"}] * 9
    busy = risk.with_region_reasons(risk.region_risk(make_reports(rows), "village")).first()
    assert busy.reasons == [
        "Elevated mortality rate (40% over the last 7 days)",
        "Reports growing quickly (7-day growth ratio 9.00x)",
        "High report volume (9 reports in 7 days)",
        "Large share of HIGH-concern reports (100%)",
    ]
