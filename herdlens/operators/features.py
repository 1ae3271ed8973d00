"""Per-report features: mortality, symptom totals, feature frame, weak label."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens import config as C
from herdlens.config import DEFAULT, Config, symptom_column
from herdlens.functions.numeric import clip, lit_double, ratio, round_exact, round_scaled
from herdlens.operators.context import with_context


def mortality(deaths: str = "number_deaths", affected: str = "number_affected") -> Column:
    return ratio(F.col(deaths), F.col(affected))


def with_mortality(df: DataFrame, digits: int | None = None, rounding: str = "exact") -> DataFrame:
    """Set ``mortality_rate``; ``rounding`` is ``exact`` (appended rows) or ``scaled`` (loaded tables)."""
    df = df.withColumn("mortality_rate", mortality())
    if digits is None:
        return df
    exact = rounding == "exact"
    rounded = round_exact("mortality_rate", digits) if exact else round_scaled(F.col("mortality_rate"), digits)
    return df.withColumn("mortality_rate", rounded)


def symptom_flag(name: str) -> Column:
    return F.coalesce(F.col(symptom_column(name)), F.lit(False))


def with_symptoms(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``symptom_count`` and the weighted ``symptom_severity``."""
    flags = {s: symptom_flag(s).cast("int") for s in cfg.symptom_weights}
    return df.withColumns(
        {
            "symptom_count": reduce(add, flags.values()),
            "symptom_severity": reduce(
                add, [flags[s] * F.lit(w) for s, w in cfg.symptom_weights.items()]
            ),
        }
    )


def engineer_features(df: DataFrame, add_context: bool = True, cfg: Config = DEFAULT) -> DataFrame:
    """The feature pass shared by training and scoring."""
    if "mortality_rate" not in df.columns:
        df = with_mortality(df)
    df = with_symptoms(df, cfg)
    return with_context(df, cfg) if add_context else df


def fill_defaults(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Values of optional fields a sender left out."""
    present = set(df.columns)

    def filled(name: str, kind: str, default):
        value = F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default).cast(kind))

    columns = {
        "number_deaths": filled("number_deaths", "int", 0),
        "duration_days": filled("duration_days", "int", 1),
        "temperature": F.nanvl(filled("temperature", "double", None), F.lit(None).cast("double")),
    }
    for symptom in cfg.symptom_weights:
        name = symptom_column(symptom)
        columns[name] = filled(name, "boolean", False)
    return df.withColumns(columns)


def feature_frame(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Exactly the classifier's columns, in order, with flags as integers."""
    missing = [c for c in C.FEATURE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing expected feature columns: {missing}")
    flags = set(C.SYMPTOM_COLUMNS)
    return df.select(
        *keep,
        *[F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in C.FEATURE_COLUMNS],
    )


def label_score(cfg: Config = DEFAULT) -> Column:
    """0-1 concern of a report; needs ``symptom_severity`` and ``mortality_rate``."""
    weights = C.LABEL_WEIGHTS
    critical = symptom_flag(C.CRITICAL_SYMPTOMS[0]) | symptom_flag(C.CRITICAL_SYMPTOMS[1])
    rate = F.coalesce(F.col("mortality_rate"), lit_double(0.0))
    return (
        lit_double(weights["mortality"]) * clip(rate / lit_double(C.LABEL_MORTALITY_SCALE), 0.0, 1.0)
        + lit_double(weights["severity"])
        * (F.col("symptom_severity").cast("double") / lit_double(sum(cfg.symptom_weights.values())))
        + lit_double(weights["affected"])
        * clip(F.col("number_affected").cast("double") / lit_double(C.LABEL_AFFECTED_SCALE), 0.0, 1.0)
        + lit_double(weights["critical"]) * critical.cast("double")
    )


def with_label(df: DataFrame, noise_seed: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Weak-supervision label for unlabelled tables.

    ``noise_seed`` adds normal noise to the score; it depends on the
    partitioning, so leave it out where results must be repeatable.
    """
    present = "symptom_severity" in df.columns
    score = label_score(cfg)
    if noise_seed is not None:
        score = score + F.randn(noise_seed) * lit_double(C.LABEL_NOISE_SD)
    low, medium = C.LABEL_CUTS
    out = (df if present else with_symptoms(df, cfg)).withColumn("_score", score)
    out = out.withColumn(
        "risk_level",
        F.when(F.col("_score") <= lit_double(low), "LOW")
        .when(F.col("_score") <= lit_double(medium), "MEDIUM")
        .otherwise("HIGH"),
    ).drop("_score")
    return out if present else out.drop("symptom_count", "symptom_severity")
