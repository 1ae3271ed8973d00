"""Running totals over a stream of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdlens.config import DEFAULT, Config

_DAY = 86400


def _event_time(day: str = "date") -> Column:
    """Midnight UTC of a day, whatever the session's time zone."""
    return F.timestamp_seconds(F.unix_date(day).cast("bigint") * _DAY)


def _day_of(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / _DAY).cast("int"))


def daily_trend_stream(reports: DataFrame, late: str = "2 days") -> DataFrame:
    """Reports and HIGH reports per day; rows later than ``late`` are dropped."""
    return (
        reports.withColumn("_at", _event_time())
        .withWatermark("_at", late)
        .groupBy(F.window("_at", "1 day").alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("reports"),
            F.count(F.when(F.col("risk_level") == "HIGH", 1)).alias("high_concern"),
        )
        .select(_day_of(F.col("_w.start")).alias("date"), "reports", "high_concern")
    )


def rapid_spread_stream(
    reports: DataFrame, min_reports: int | None = None, late: str = "2 days", cfg: Config = DEFAULT
) -> DataFrame:
    """Villages and days whose last days together reach ``min_reports``.

    Counts every report. The rule counts the *other* reports of a report's
    village, so one more than its threshold is its equivalent here.
    """
    needed = cfg.rapid_min_reports if min_reports is None else min_reports
    return (
        reports.withColumn("_at", _event_time())
        .withWatermark("_at", late)
        .groupBy("village", F.window("_at", f"{cfg.rapid_window_days} days", "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= needed)
        .select("village", F.date_sub(_day_of(F.col("_w.end")), 1).alias("date"), "n")
    )


def run_updates(updates: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write the changed rows of every micro-batch; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch_id={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current(spark: SparkSession, folder: str, updates: DataFrame, keys: list) -> DataFrame:
    """The latest row of each key."""
    values = [c for c in updates.columns if c not in keys]
    rows = spark.read.schema(f"{_ddl(updates)}, batch_id BIGINT").parquet(f"{folder}/updates")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(
        *keys, *[F.col(f"_v.{v}").alias(v) for v in values]
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
