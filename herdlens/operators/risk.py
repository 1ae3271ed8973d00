"""Transparent 0-100 risk score of a region, its category and its reasons."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens import texts
from herdlens.config import CATEGORY_FLOORS, DEFAULT, REASON_FLOORS, Config
from herdlens.functions.numeric import (
    clip, fixed_text, kept, lit_double, normalized, percent_text, round_exact,
)
from herdlens.operators.rollup import (
    coarser, region_measures, region_rollup, rollup_from_measures,
)
from herdlens.session import materialize

LEVELS = ("village", "block", "district")


def risk_category(score: Column) -> Column:
    score = clip(score, 0.0, 100.0)
    chain = F
    for name, floor in CATEGORY_FLOORS:
        chain = chain.when(score >= lit_double(floor), name) if floor is not None else chain.otherwise(name)
    return chain


def with_risk_score(rollup: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Weighted sum of five capped components of the (rounded) rollup."""
    caps, weights = cfg.score_caps, cfg.score_weights
    growth = F.greatest(lit_double(0), F.col("report_growth_rate") - lit_double(1))
    parts = {
        "volume": normalized(F.col("report_count_7d"), caps["volume"]),
        "growth": normalized(growth, caps["growth"]),
        "mortality": normalized(F.col("mortality_rate"), caps["mortality"]),
        "high_concern": normalized(F.col("high_concern_ratio"), caps["high_concern"]),
        "historical": normalized(F.col("historical_incidence"), caps["historical"]),
    }
    components = rollup.withColumns({f"_{name}": part for name, part in parts.items()})
    weighted = reduce(add, [lit_double(weights[name]) * F.col(f"_{name}") for name in parts])
    totalled = components.withColumn("_total", clip(weighted, 0.0, 100.0))
    scored = totalled.withColumn("risk_score", round_exact("_total", 1))
    return scored.select(
        *rollup.columns,
        "risk_score",
        risk_category(F.col("risk_score")).alias("risk_category"),
        *[round_exact(f"_{name}", 1).alias(f"sub_score_{name}") for name in parts],
    )


def region_risk(
    reports: DataFrame, level: str, as_of=None, cfg: Config = DEFAULT, ordered: bool = True
) -> DataFrame:
    """Scored regions of one level, highest score first; an empty input keeps the schema."""
    scored = with_risk_score(region_rollup(reports, level, as_of, cfg), cfg)
    return by_score(scored, level) if ordered else scored


def by_score(scored: DataFrame, level: str) -> DataFrame:
    return scored.orderBy(F.desc("risk_score"), F.asc(level))


def all_levels(reports: DataFrame, as_of=None, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """All three levels from one reading of the reports: written sums of the finest level."""
    finest = materialize(region_measures(reports, ["district", "block", "village"], as_of, cfg), "measures")
    return {
        level: with_risk_score(rollup_from_measures(coarser(finest, level), level), cfg)
        for level in LEVELS
    }


def with_region_reasons(risk: DataFrame) -> DataFrame:
    """Add ``reasons``: what drove each region's score."""

    def when_high(name: str, text: Column) -> Column:
        return F.when(F.col(f"sub_score_{name}") >= lit_double(REASON_FLOORS[name]), text)

    reasons = kept(
        when_high("mortality", F.format_string(texts.REGION_MORTALITY, percent_text("mortality_rate"))),
        when_high("growth", F.format_string(texts.REGION_GROWTH, fixed_text("report_growth_rate", 2))),
        when_high("volume", F.format_string(texts.REGION_VOLUME, F.col("report_count_7d"))),
        when_high(
            "high_concern",
            F.format_string(texts.REGION_HIGH_CONCERN, percent_text("high_concern_ratio")),
        ),
        when_high("historical", F.format_string(texts.REGION_HISTORY, F.col("historical_incidence"))),
    )
    return risk.withColumn("_found", reasons).select(
        *risk.columns,
        F.when(F.size("_found") == 0, F.array(F.lit(texts.REGION_NONE))).otherwise(F.col("_found")).alias("reasons"),
    )
