"""Recent history of a report's village, without seeing the report itself.

All windows run over one row per village and day. The reports of a village and
day are first combined on the map side, so a village that sends a third of all
reports is still no more than one row per calendar day in its window, and the
way back to the reports is an equi-join whose other side has one row per key,
which adaptive execution splits where a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens.config import DEFAULT, Config
from herdlens.functions.numeric import ratio, round_exact

CONTEXT_COLUMNS = (
    "recent_reports", "recent_reports_prev", "historical_incidence",
    "spread_velocity", "rapid_spread",
)


def is_high(df: DataFrame) -> Column:
    if "risk_level" not in df.columns:
        return F.lit(0)
    return F.coalesce((F.col("risk_level") == "HIGH").cast("int"), F.lit(0))


def daily_counts(reports: DataFrame) -> DataFrame:
    """One row per village and day: reports ``n`` and HIGH reports ``n_high``."""
    return (
        reports.where(F.col("village").isNotNull() & F.col("date").isNotNull())
        .groupBy("village", "date")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(is_high(reports)).alias("n_high"))
    )


def _windowed(daily: DataFrame, cfg: Config) -> DataFrame:
    """Counts of each frame that ends at, or lies before, the row's day."""
    by_day = Window.partitionBy("village").orderBy("_day")
    short = cfg.short_days

    def total(column: str, start: int, end: int) -> Column:
        frame = by_day.rangeBetween(start, end)
        return F.coalesce(F.sum(column).over(frame), F.lit(0))

    return daily.withColumn("_day", F.unix_date("date")).select(
        *daily.columns,
        total("n", 1 - short, 0).alias("_recent"),
        total("n", 1 - 2 * short, -short).alias("_previous"),
        total("n", 1 - cfg.rapid_window_days, 0).alias("_rapid"),
        total("n_high", Window.unboundedPreceding, -1).alias("_history"),
    )


def with_counts(targets: DataFrame, daily: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Frame counts (``_recent`` ...) of each target's village up to its date.

    Days of the history (``daily``) and asked-for days share one set of
    windows; asked-for days carry no reports of their own, so no range join is
    needed.
    """
    asked = (
        targets.where(F.col("village").isNotNull() & F.col("date").isNotNull())
        .select("village", "date")
        .distinct()
        .withColumns({"n": F.lit(0).cast("bigint"), "n_high": F.lit(0).cast("bigint")})
    )
    # Only villages asked for; few enough to broadcast, they filter before the counting.
    known = daily.join(asked.select("village").distinct(), "village", "left_semi").select(*asked.columns)
    both = known.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)))
    windows = _windowed(both, cfg).where("_asked").drop("n", "n_high", "_asked")
    return targets.join(windows, ["village", "date"], "left")


def named_context(counted: DataFrame, keep: list, own: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Turn frame counts into the context columns; ``own`` is the row's own share."""
    zero = F.lit(0).cast("bigint")
    named = counted.select(
        *keep,
        F.greatest(F.coalesce(F.col("_recent") - own, zero), zero).alias("recent_reports"),
        F.coalesce("_previous", zero).alias("recent_reports_prev"),
        F.coalesce("_history", zero).alias("historical_incidence"),
        (F.coalesce(F.col("_rapid") - own, zero) >= cfg.rapid_min_reports).alias("rapid_spread"),
    )
    recent, previous = F.col("recent_reports"), F.col("recent_reports_prev")
    return named.withColumn("_velocity", ratio(recent, previous, recent)).select(
        *keep,
        "recent_reports",
        "recent_reports_prev",
        "historical_incidence",
        round_exact("_velocity", 3).alias("spread_velocity"),
        "rapid_spread",
    )


def other_columns(df: DataFrame) -> list:
    return [c for c in df.columns if c not in CONTEXT_COLUMNS]


def with_context(reports: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Context of every report of a table, the report itself left out."""
    windows = _windowed(daily_counts(reports), cfg).drop("n", "n_high")
    joined = reports.drop(*CONTEXT_COLUMNS).join(windows, ["village", "date"], "left")
    return named_context(joined, other_columns(reports), F.lit(1), cfg)


def with_history_context(incoming: DataFrame, history: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Context of incoming reports against a history that does not hold them."""
    counted = with_counts(incoming.drop(*CONTEXT_COLUMNS), daily_counts(history), cfg)
    return named_context(counted, other_columns(incoming), F.lit(0), cfg)


def village_context(reports: DataFrame, targets: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Context of any (village, date) targets, each optionally without one report.

    Where ``targets`` has ``exclude_report_id``, that report's own share is
    taken off its village's counts.
    """
    if "exclude_report_id" not in targets.columns:
        return with_history_context(targets, reports, cfg)

    keep = other_columns(targets)
    plain = with_counts(targets, daily_counts(reports), cfg)
    left_out = reports.select(
        F.col("report_id").alias("exclude_report_id"),
        F.col("village").alias("_x_village"),
        F.col("date").alias("_x_date"),
        is_high(reports).alias("_x_high"),
    )
    age = F.datediff("date", "_x_date")
    same = F.col("village") == F.col("_x_village")
    short = cfg.short_days

    def less(count: str, condition: Column, amount: Column = F.lit(1)) -> Column:
        return F.col(count) - F.when(same & condition, amount).otherwise(0)

    joined = plain.join(left_out, "exclude_report_id", "left").withColumns(
        {
            "_recent": less("_recent", age.between(0, short - 1)),
            "_previous": less("_previous", age.between(short, 2 * short - 1)),
            "_rapid": less("_rapid", age.between(0, cfg.rapid_window_days - 1)),
            "_history": less("_history", age > 0, F.col("_x_high")),
        }
    )
    return named_context(joined, keep, F.lit(0), cfg)
