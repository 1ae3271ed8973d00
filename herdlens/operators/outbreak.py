"""Outbreak detection: clustered reports, cluster summary, severity groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens import texts
from herdlens.config import DEFAULT, SEVERITY_COLUMNS, Config
from herdlens.functions.numeric import literal_map, ratio, round_exact, round_scaled
from herdlens.operators.features import engineer_features
from herdlens.operators.skew import lookup_join
from herdlens.operators.stdbscan import st_dbscan
from herdlens.operators.tmixture import TMixtureModel, fit_t_mixture
from herdlens.session import materialize

SUMMARY_SCHEMA = (
    "st_cluster", "n_reports", "n_villages", "n_districts", "villages", "dominant_village",
    "date_start", "date_end", "duration_days", "total_affected", "total_deaths",
    "mean_mortality_rate", "high_concern_reports", "dominant_severity_group",
    "avg_severity_confidence", "scale", "flagged_as_outbreak",
)
FLAGGED_COLUMNS = (
    "st_cluster", "dominant_village", "n_reports", "n_villages", "date_start", "date_end",
    "duration_days", "total_deaths", "mean_mortality_rate", "dominant_severity_group", "scale",
)


@dataclass(frozen=True)
class Outbreaks:
    reports: DataFrame
    cluster_summary: DataFrame
    severity_groups: DataFrame
    totals: DataFrame  # n_clusters_found, n_noise_reports
    mixture: TMixtureModel


def with_coordinates(reports: DataFrame, regions: DataFrame) -> DataFrame:
    """Reports of villages whose coordinates are known."""
    places = regions.select("village", "latitude", "longitude")
    return reports.drop("latitude", "longitude").join(drop_unlocated(places), "village")


def drop_unlocated(df: DataFrame) -> DataFrame:
    """Rows with both coordinates."""
    return df.dropna(subset=["latitude", "longitude"])


def with_day_offset(df: DataFrame) -> DataFrame:
    first = df.agg(F.min("date").alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn(  # one row
        "day_offset", F.datediff("date", "_first")
    ).drop("_first")


def standard_scale(df: DataFrame, columns: list, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation per column; a constant column scales by 1."""
    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    first = df.agg(
        F.sum(n).alias("n"), *[F.sum(n * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    if not first.n:
        return np.zeros(len(columns)), np.ones(len(columns))
    means = np.array([first[f"s{i}"] / first.n for i in range(len(columns))])
    second = df.agg(
        *[
            F.sum(n * F.pow(F.col(c) - F.lit(float(means[i])), F.lit(2.0))).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    spread = np.sqrt(np.array([second[f"s{i}"] / first.n for i in range(len(columns))]))
    return means, np.where(spread == 0.0, 1.0, spread)


def scaled(name: str, mean: float, spread: float) -> Column:
    return (F.col(name).cast("double") - F.lit(float(mean))) / F.lit(float(spread))


def standardized(df: DataFrame, columns: list) -> DataFrame:
    """``columns`` as z-scores named ``z_<column>``."""
    means, spreads = standard_scale(df, columns)
    return df.withColumns({f"z_{c}": scaled(c, means[i], spreads[i]) for i, c in enumerate(columns)})


def severity_rank(means: np.ndarray) -> dict[int, int]:
    """Component -> rank, 0 the mildest, by the sum of its standardised means."""
    order = np.argsort(means.sum(axis=1), kind="stable")
    return {int(component): rank for rank, component in enumerate(order)}


def severity_names(groups: int) -> dict[int, str]:
    if groups == len(texts.SEVERITY_NAMES):
        return dict(enumerate(texts.SEVERITY_NAMES))
    return {rank: f"Group {rank + 1}" for rank in range(groups)}


def _profiles(reports: DataFrame, cfg: Config) -> DataFrame:
    """Reports with their severity profile, gaps filled with 0."""
    featured = engineer_features(reports, add_context=False, cfg=cfg)
    return featured.withColumns(
        {f"_p_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in SEVERITY_COLUMNS}
    )


def grade_severity(
    reports: DataFrame,
    n_groups: int | None = None,
    dof: float | None = None,
    cfg: Config = DEFAULT,
    fit_on: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, TMixtureModel | None]:
    """Reports with severity columns, the groups' centres, and the mixture (None without reports).

    ``fit_on`` holds the same reports where those are cheaper to read.
    """
    k = cfg.severity_groups if n_groups is None else n_groups
    profile = [f"_p_{c}" for c in SEVERITY_COLUMNS]
    profiled = _profiles(reports, cfg)
    # Distinct profiles with their counts: what all the fitting reads.
    distinct = materialize(
        (profiled if fit_on is None else _profiles(fit_on, cfg))
        .groupBy(*profile).agg(F.count(F.lit(1)).alias("n")),
        "profiles",
    )
    schema = T.StructType(
        [T.StructField(c, T.DoubleType()) for c in SEVERITY_COLUMNS]
        + [
            T.StructField("raw_component", T.IntegerType()),
            T.StructField("rank", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("mixture_weight", T.DoubleType()),
        ]
    )
    if distinct.isEmpty():  # no groups to tell apart, and no mixture
        nothing = {
            "severity_group_raw": "int", "severity_group_rank": "int", "severity_confidence": "double", "severity_group": "string"
        }
        graded = reports.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])
        return graded, reports.sparkSession.createDataFrame([], schema), None
    means, spreads = standard_scale(distinct, profile, "n")
    z = [f"_z{i}" for i in range(len(profile))]

    def to_z(df: DataFrame) -> DataFrame:
        return df.withColumns({z[i]: scaled(c, means[i], spreads[i]) for i, c in enumerate(profile)})

    mixture = fit_t_mixture(to_z(distinct), z, k, dof, weight="n", cfg=cfg)
    rank = severity_rank(mixture.fitted.means)
    names = severity_names(k)
    # Grades are worked out once per profile and looked up by the reports.
    assigned = mixture.assign(to_z(distinct), "severity_group_raw", "_confidence")
    grades = assigned.withColumn("severity_group_rank", literal_map(rank)[F.col("severity_group_raw")]).select(
        *profile,
        "severity_group_raw",
        "severity_group_rank",
        round_scaled(F.col("_confidence"), 3).alias("severity_confidence"),
        literal_map(names)[F.col("severity_group_rank")].alias("severity_group"),
    )
    graded = lookup_join(profiled, grades, profile).select(
        *reports.columns, "severity_group_raw", "severity_group_rank", "severity_confidence", "severity_group"
    )
    centres = mixture.fitted.means * spreads + means
    rows = sorted(
        (
            (*[float(v) for v in centres[c]], c, rank[c], names[rank[c]], float(mixture.fitted.weights[c]))
            for c in range(k)
        ),
        key=lambda r: r[len(profile) + 1],
    )
    return graded, reports.sparkSession.createDataFrame(rows, schema), mixture


def cluster_summary(clustered: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per cluster, flagged clusters first, then by deaths and size.

    Reports are combined per cluster, place and severity first, so names are
    counted and listed over places, not over reports.
    """
    columns = set(clustered.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast(kind)

    labelled = "risk_level" in columns
    parts = (
        clustered.where("st_cluster >= 0")
        .select(
            "st_cluster", "village", "district", "date", "number_affected", "number_deaths",
            given("severity_group", "string").alias("severity_group"),
            given("severity_confidence", "double").alias("severity_confidence"),
            (given("risk_level", "string") == "HIGH").cast("int").alias("_high"),
        )
        .groupBy("st_cluster", "village", "district", "severity_group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
            F.sum("number_affected").alias("affected"),
            F.sum("number_deaths").alias("deaths"),
            F.sum("_high").alias("high"),
            # Decimal sums do not depend on the order of the rows.
            F.sum(F.col("severity_confidence").cast("decimal(18,9)")).alias("confidence"),
        )
    )
    parts = materialize(parts, "cluster-parts")
    main = parts.groupBy("st_cluster").agg(
        F.sum("n").alias("n_reports"),
        F.countDistinct("village").alias("n_villages"),
        F.countDistinct("district").alias("n_districts"),
        F.min("first").alias("date_start"),
        F.max("last").alias("date_end"),
        F.coalesce(F.sum("affected"), F.lit(0)).alias("total_affected"),
        F.coalesce(F.sum("deaths"), F.lit(0)).alias("total_deaths"),
        (F.coalesce(F.sum("high"), F.lit(0)) if labelled else F.lit(None).cast("bigint")).alias("high_concern_reports"),
        (F.sum("confidence").cast("double") / F.sum("n")).alias("_confidence"),
    )

    def most_frequent(column: str, alias: str) -> DataFrame:
        counts = parts.where(F.col(column).isNotNull()).groupBy("st_cluster", column).agg(F.sum("n").alias("n"))
        return counts.groupBy("st_cluster").agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("value")))["value"].alias(alias)
        )

    # The row_number filter also cuts each map side down to three rows per cluster.
    by_name = Window.partitionBy("st_cluster").orderBy("village")
    first_names = (
        parts.where(F.col("village").isNotNull()).select("st_cluster", "village").distinct()
        .withColumn("_place", F.row_number().over(by_name))
        .where("_place <= 3")
        .groupBy("st_cluster")
        .agg(F.array_join(F.array_sort(F.collect_list("village")), ", ").alias("_names"))
    )
    joined = (
        main.join(first_names, "st_cluster", "left")
        .join(most_frequent("village", "dominant_village"), "st_cluster", "left")
        .join(most_frequent("severity_group", "dominant_severity_group"), "st_cluster", "left")
        .withColumn("duration_days", F.datediff("date_end", "date_start") + 1)
        .withColumn(
            "_rate", ratio(F.col("total_deaths"), F.greatest(F.lit(1), F.col("total_affected")))
        )
    )
    spread_out = (F.col("n_villages") >= cfg.epidemic_places) | (F.col("n_districts") >= cfg.epidemic_places)
    epidemic = spread_out & (F.col("duration_days") >= cfg.epidemic_days)
    return joined.select(
        "st_cluster", "n_reports", "n_villages", "n_districts",
        F.concat("_names", F.when(F.col("n_villages") > 3, "...").otherwise("")).alias("villages"),
        "dominant_village", "date_start", "date_end", "duration_days", "total_affected", "total_deaths",
        round_exact("_rate", 3).alias("mean_mortality_rate"),
        "high_concern_reports",
        "dominant_severity_group",
        round_exact("_confidence", 3).alias("avg_severity_confidence"),
        F.when(epidemic, texts.SCALE_EPIDEMIC).otherwise(texts.SCALE_LOCAL).alias("scale"),
        (F.col("total_deaths") >= cfg.outbreak_deaths).alias("flagged_as_outbreak"),
    ).orderBy(F.desc("flagged_as_outbreak"), F.desc("total_deaths"), F.desc("n_reports"), F.asc("st_cluster"))


def cluster_totals(clustered: DataFrame) -> DataFrame:
    return clustered.agg(
        F.countDistinct(F.when(F.col("st_cluster") >= 0, F.col("st_cluster"))).alias("n_clusters_found"),
        F.count(F.when(F.col("st_cluster") == -1, 1)).alias("n_noise_reports"),
    )


def clustered_reports(
    reports: DataFrame, regions: DataFrame, eps_km=None, eps_days=None, min_samples=None, cfg: Config = DEFAULT
) -> DataFrame:
    """Located reports with ``day_offset`` and ``st_cluster``."""
    return st_dbscan(located_reports(reports, regions), eps_km, eps_days, min_samples, cfg=cfg)


def located_reports(reports: DataFrame, regions: DataFrame) -> DataFrame:
    return with_day_offset(with_coordinates(reports, regions))


def detect_outbreaks(
    reports: DataFrame,
    regions: DataFrame,
    eps_km: float | None = None,
    eps_days: float | None = None,
    min_samples: int | None = None,
    n_severity_groups: int | None = None,
    dof: float | None = None,
    cfg: Config = DEFAULT,
) -> Outbreaks:
    """Clusters in space and time, each graded by the severity of its reports."""
    located = located_reports(reports, regions)
    clustered = st_dbscan(located, eps_km, eps_days, min_samples, cfg=cfg)
    graded, groups, mixture = grade_severity(clustered, n_severity_groups, dof, cfg, fit_on=located)
    graded = materialize(graded, "graded")  # read by the summary, the totals and the caller
    return Outbreaks(graded, cluster_summary(graded, cfg), groups, cluster_totals(graded), mixture)


def flagged_clusters(summary: DataFrame) -> DataFrame:
    return summary.where("flagged_as_outbreak").select(*FLAGGED_COLUMNS)


def validate_outbreaks(summary: DataFrame, known: DataFrame) -> DataFrame:
    """Flagged villages against a table of villages known to have had outbreaks."""
    flagged = summary.where("flagged_as_outbreak").select(
        F.col("dominant_village").alias("village"), F.lit(1).alias("_flagged")
    ).distinct()
    expected = known.select("village", F.lit(1).alias("_known")).distinct()
    both = flagged.join(expected, "village", "full_outer")
    hit = F.col("_flagged").isNotNull()
    real = F.col("_known").isNotNull()
    counts = both.agg(
        F.count(F.when(real, 1)).alias("n_known"),
        F.count(F.when(hit, 1)).alias("n_flagged"),
        F.count(F.when(hit & real, 1)).alias("true_positives"),
        F.count(F.when(hit & ~real, 1)).alias("false_positives"),
        F.count(F.when(~hit & real, 1)).alias("false_negatives"),
    )
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    rates = counts.withColumn("_precision", ratio(tp, tp + fp)).withColumn("_recall", ratio(tp, tp + fn))
    return rates.select(
        *counts.columns,
        round_exact("_precision", 3).alias("precision"),
        round_exact("_recall", 3).alias("recall"),
    )
