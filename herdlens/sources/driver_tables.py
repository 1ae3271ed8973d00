"""Health reports derived from the event and nation tables of the test data.

Events are reports, users are villages, nations are blocks, regions are
districts. Column formulas follow FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.config import DEFAULT, Config, symptom_column
from herdlens.operators.features import mortality, with_label

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"
REGION = "r_regionkey INT, r_name STRING"

# Column formulas over event ``e`` and the number ``k`` in its properties.
SPECIES_OF = {
    "click": "cattle", "error": "buffalo", "purchase": "goat", "signup": "sheep", "view": "poultry",
}
FLAGS = {
    "fever": "e % 3 = 0",
    "coughing": "(e + 1) % 4 = 0",
    "nasal_discharge": "(e + 2) % 5 = 0",
    "weakness": "(e + 3) % 4 = 0",
    "diarrhea": "(e + 1) % 7 = 0",
    "loss_of_appetite": "(e + k) % 5 = 0",
    "reduced_milk_production": "(e + k) % 7 = 0",
    "skin_lesions": "(e + 3) % 12 = 0",
    "swelling": "(e + k) % 13 = 0",
    "respiratory_distress": "(e + 5) % 17 = 0",
    "neurological_symptoms": "(e + 7) % 50 = 0",
    "sudden_death": "(e + k) % 53 = 0",
}


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and district names; a fixed dimension of 25 rows."""
    nation = spark.read.schema(NATION).parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.schema(REGION).parquet(f"{sf_dir}/region.parquet")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "CAST(n_nationkey AS BIGINT) AS _nation", "n_name AS block", "r_name AS district"
    )


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def dealt(events: DataFrame) -> DataFrame:
    """The same events dealt over all tasks.

    A row group is read by one task, and what follows without a shuffle stays there,
    however many rows it has. The columns are those that every report needs; several,
    as ids may repeat or be null.
    """
    return events.repartition("event_id", "user_id", "value", "props")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream."""
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/event[s].parquet")


def reports(
    spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT, label: bool = True, events: DataFrame | None = None
) -> DataFrame:
    events = event_table(spark, sf_dir) if events is None else events
    species = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in SPECIES_OF.items())
    numbered = events.selectExpr(
        "*", "event_id AS e", "CAST(get_json_object(props, '$.k') AS INT) AS k", "user_id % 25 AS _nation"
    )
    rows = numbered.join(F.broadcast(_places(spark, sf_dir)), "_nation").selectExpr(
        "event_id AS report_id",
        "CAST(ts AS DATE) AS date",
        "district",
        "block",
        "concat('V', CAST(user_id AS STRING)) AS village",
        f"CASE event_type {species} END AS species",
        "1 + k % 20 AS number_affected",
        "least(1 + k % 20, CAST(floor(value / 60D) AS INT)) AS number_deaths",
        "1 + k % 9 AS duration_days",
        "CASE WHEN e % 10 >= 3 THEN 37.6D + CAST(k % 39 AS DOUBLE) / 10D END AS temperature",
        "'' AS notes",
        *[f"{rule} AS {symptom_column(name)}" for name, rule in FLAGS.items()],
    ).withColumn("mortality_rate", mortality())
    return with_label(rows, cfg=cfg) if label else rows


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per village with its coordinates."""
    users = event_table(spark, sf_dir).select("user_id").distinct().selectExpr("user_id", "user_id % 25 AS _nation")
    return users.join(F.broadcast(_places(spark, sf_dir)), "_nation").selectExpr(
        "district",
        "block",
        "concat('V', CAST(user_id AS STRING)) AS village",
        "16D + 0.2D * CAST(_nation AS DOUBLE) + 0.0095D * CAST(user_id DIV 25 AS DOUBLE) AS latitude",
        "73D + 0.25D * CAST(_nation AS DOUBLE) AS longitude",
    )
