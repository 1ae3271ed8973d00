"""Filters, totals, rankings, trends and markers of the surveillance view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens import texts
from herdlens.config import DEFAULT, Config
from herdlens.functions.numeric import fixed_text, lit_double, literal_map, percent_text
from herdlens.operators.outbreak import drop_unlocated
from herdlens.operators.rollup import as_date

RECENT_COLUMNS = (
    "date", "district", "block", "village", "species", "number_affected",
    "number_deaths", "mortality_rate", "risk_level", "notes",
)
RANKING_COLUMNS = (
    "risk_score", "risk_category", "report_count_7d", "report_count_30d", "affected_animals",
    "deaths", "mortality_rate", "high_concern_count", "report_growth_rate", "historical_incidence",
)


def filter_reports(
    reports: DataFrame, districts=None, blocks=None, species=None, start=None, end=None
) -> DataFrame:
    """Reports of the chosen places, species and days (both ends included)."""
    out = reports
    for column, chosen in (("district", districts), ("block", blocks), ("species", species)):
        if chosen is not None:
            out = out.where(F.col(column).isin(list(chosen)))
    if start is not None:
        out = out.where(F.col("date") >= as_date(start))
    if end is not None:
        out = out.where(F.col("date") <= as_date(end))
    return out


def filter_risk_levels(reports: DataFrame, levels) -> DataFrame:
    return reports.where(F.col("risk_level").isin(list(levels)))


def in_chosen(reports: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """Reports whose ``column`` occurs in a table of choices."""
    return reports.join(chosen.select(column).distinct(), column, "left_semi")


def options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct choices."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def date_bounds(reports: DataFrame) -> DataFrame:
    return reports.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def shown_of_total(filtered: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows shown, rows in all, and the day the scores refer to."""
    shown = filtered.agg(F.count(F.lit(1)).alias("shown"), F.max("date").alias("_last_shown"))
    total = reports.agg(F.count(F.lit(1)).alias("total"), F.max("date").alias("_last"))
    return shown.crossJoin(total).select(  # one row each
        "shown", "total", F.coalesce("_last_shown", "_last").alias("as_of")
    )


def kpis(filtered: DataFrame, village_risk: DataFrame) -> DataFrame:
    """Totals of the shown reports and the number of regions at high risk."""
    totals = filtered.agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.coalesce(F.sum("number_affected"), F.lit(0)).alias("affected_animals"),
        F.coalesce(F.sum("number_deaths"), F.lit(0)).alias("deaths"),
        F.count(F.when(F.col("risk_level") == "HIGH", 1)).alias("high_concern_reports"),
    )
    risky = village_risk.agg(
        F.count(F.when(F.col("risk_category").isin("HIGH", "CRITICAL"), 1)).alias("high_risk_regions")
    )
    return totals.crossJoin(risky)  # one row each


def daily_trend(reports: DataFrame) -> DataFrame:
    """Reports and HIGH reports per day; days without reports are absent."""
    return (
        reports.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(
            F.count("report_id").alias("reports"),
            F.count(F.when(F.col("risk_level") == "HIGH", 1)).alias("high_concern"),
        )
        .orderBy("date")
    )


def score_histogram(risk: DataFrame, bins: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Regions per equal-width score bin between the least and greatest score."""
    bins = cfg.histogram_bins if bins is None else bins
    ends = risk.agg(F.min("risk_score").alias("_a"), F.max("risk_score").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(
        F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_low"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_high"),
    )
    span = F.col("_high") - F.col("_low")
    place = F.floor((F.col("risk_score") - F.col("_low")) / span * lit_double(bins))
    counts = (
        risk.crossJoin(F.broadcast(ends))  # one row
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edge = span * F.col("bin").cast("double") / lit_double(bins)
    frame = risk.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        frame.crossJoin(F.broadcast(ends))
        .join(counts, "bin", "left")
        .select("bin", (F.col("_low") + edge).alias("low"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
        .orderBy("bin")
    )


def top_regions(risk: DataFrame, level: str, n: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    n = cfg.top_regions if n is None else n
    return risk.orderBy(F.desc("risk_score"), F.asc(level)).limit(n)


def recent_reports(reports: DataFrame, levels=None, n: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """The latest reports of the chosen risk levels."""
    n = cfg.recent_rows if n is None else n
    chosen = filter_risk_levels(reports, cfg.risk_levels if levels is None else levels)
    latest = chosen.orderBy(F.desc("date"), F.desc("report_id")).limit(n)
    return latest.select(*RECENT_COLUMNS)


def matching_count(reports: DataFrame, levels=None, cfg: Config = DEFAULT) -> DataFrame:
    chosen = filter_risk_levels(reports, cfg.risk_levels if levels is None else levels)
    return chosen.agg(F.count(F.lit(1)).alias("matching"))


def badge(category: Column) -> Column:
    return literal_map(texts.BADGES)[category]


def ranking(risk: DataFrame, level: str) -> DataFrame:
    """The ranking table of one level, badge first."""
    return risk.select(badge(F.col("risk_category")).alias("badge"), level, *RANKING_COLUMNS).orderBy(
        F.desc("risk_score"), F.asc(level)
    )


def with_region_places(risk: DataFrame, regions: DataFrame) -> DataFrame:
    """Village risk with the village's block, district and coordinates."""
    return risk.join(regions, "village", "left")


def hotspot_markers(risk: DataFrame, regions: DataFrame) -> DataFrame:
    """What a map needs to draw one marker per located village."""
    placed = drop_unlocated(with_region_places(risk, regions))
    category = F.coalesce("risk_category", F.lit("LOW"))
    score = F.coalesce("risk_score", F.lit(0.0))
    colour = F.coalesce(literal_map(texts.COLORS)[category], F.lit(texts.COLORS["LOW"]))
    return placed.select(
        "village", "block", "district", "latitude", "longitude",
        F.col("risk_score"), category.alias("risk_category"),
        colour.alias("color"),
        (lit_double(6) + F.least(lit_double(14), score / lit_double(6))).alias("radius"),
        F.concat("village", F.lit(" - "), category).alias("tooltip"),
        F.concat("block", F.lit(", "), "district").alias("place_text"),
        F.concat(fixed_text("risk_score", 0), F.lit("/100")).alias("score_text"),
        "report_count_7d", "affected_animals", "deaths",
        percent_text("mortality_rate", 1).alias("mortality_text"),
        "high_concern_count",
        F.concat(fixed_text("report_growth_rate", 2), F.lit("x")).alias("growth_text"),
    )


def legend(spark) -> DataFrame:
    """Marker colour per category."""
    return spark.createDataFrame(list(texts.COLORS.items()), "risk_category string, color string")
