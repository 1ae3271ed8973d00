"""Rolling region rollups.

Everything measured is a conditional sum, so one aggregation with map-side
combination serves a region of any size, and the measures of a village add up
to those of its block and district.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.config import DEFAULT, Config
from herdlens.functions.numeric import ratio, round_exact

MEASURES = ("c_short", "c_long", "c_previous", "affected", "deaths", "high", "high_before")


def as_date(value) -> Column:
    return F.to_date(F.lit(value)) if isinstance(value, str) else F.lit(value).cast("date")


def region_measures(reports: DataFrame, keys: list, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    """Additive window measures per ``keys`` as of a date (default: the last one).

    Regions without any report in a window keep their row, so no date bound is
    pushed below the aggregation.
    """
    columns = [*keys, "date", "number_affected", "number_deaths", "risk_level"]
    rows = reports.select(*dict.fromkeys(columns))
    if as_of is None:
        last = reports.agg(F.max("date").alias("_as_of"))
        rows = rows.crossJoin(F.broadcast(last))  # one row
    else:
        rows = rows.withColumn("_as_of", as_date(as_of))

    age = F.datediff("_as_of", "date")
    short = age.between(0, cfg.short_days - 1)
    high = F.col("risk_level") == "HIGH"

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(short, F.col(column))), F.lit(0)).cast("bigint")

    return rows.groupBy(*keys).agg(
        count(short).alias("c_short"),
        count(age.between(0, cfg.long_days - 1)).alias("c_long"),
        count(age.between(cfg.short_days, 2 * cfg.short_days - 1)).alias("c_previous"),
        total("number_affected").alias("affected"),
        total("number_deaths").alias("deaths"),
        count(short & high).alias("high"),
        count((age > 0) & high).alias("high_before"),
    )


def rollup_from_measures(measures: DataFrame, region_col: str) -> DataFrame:
    """Counts and rounded rates of each region."""
    c_short = F.col("c_short")
    rates = measures.where(F.col(region_col).isNotNull()).withColumns(
        {
            "_mortality": ratio(F.col("deaths"), F.col("affected")),
            "_share": ratio(F.col("high"), c_short),
            "_growth": ratio(c_short, F.col("c_previous"), c_short),
        }
    )
    return rates.select(
        region_col,
        c_short.alias("report_count_7d"),
        F.col("c_long").alias("report_count_30d"),
        F.col("affected").alias("affected_animals"),
        "deaths",
        round_exact("_mortality", 4).alias("mortality_rate"),
        F.col("high").alias("high_concern_count"),
        round_exact("_share", 4).alias("high_concern_ratio"),
        round_exact("_growth", 4).alias("report_growth_rate"),
        F.col("high_before").alias("historical_incidence"),
    )


def region_rollup(reports: DataFrame, region_col: str, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    return rollup_from_measures(region_measures(reports, [region_col], as_of, cfg), region_col)


def coarser(measures: DataFrame, region_col: str) -> DataFrame:
    """Add finer measures up to one row per ``region_col``."""
    return measures.groupBy(region_col).agg(*[F.sum(m).alias(m) for m in MEASURES])
