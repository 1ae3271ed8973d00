"""Reading and writing the report and region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens import schema
from herdlens.functions.numeric import round_exact
from herdlens.operators.features import mortality
from herdlens.operators.skew import numbered


def _read(spark: SparkSession, path: str, kind: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(kind)
    if fmt == "csv":
        # Flags may be written True/False or true/false; dates are ISO days.
        return reader.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return reader.format(fmt).load(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    return df.withColumns(
        {
            f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType))
            for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        }
    )


def read_reports(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return without_nan(_read(spark, path, schema.REPORTS, fmt))


def read_regions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return without_nan(_read(spark, path, schema.REGIONS, fmt))


def with_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """``column`` as a date; text is parsed, dates pass, timestamps keep their day."""
    if isinstance(df.schema[column].dataType, T.DateType):
        return df
    return df.withColumn(column, F.to_date(column))


def write_reports(reports: DataFrame, path: str, fmt: str = "parquet", by_date: bool = True) -> None:
    """Write reports, one folder per day, so that date filters prune files.

    Rebalancing by day keeps files whole and splits a busy day over tasks.
    """
    if by_date:
        out = reports.hint("rebalance", "date").write.mode("overwrite").partitionBy("date")
    else:
        out = reports.write.mode("overwrite")
    _save(out, path, fmt)


def write_regions(regions: DataFrame, path: str, fmt: str = "parquet") -> None:
    _save(regions.write.mode("overwrite"), path, fmt)


def _save(writer, path: str, fmt: str) -> None:
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def union_reports(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name, absent ones null."""
    return first.unionByName(second, allowMissingColumns=True)


def _rounded_mortality(df: DataFrame) -> DataFrame:
    rated = df.withColumn("_rate", mortality())
    return rated.withColumn("mortality_rate", round_exact("_rate", 4)).drop("_rate")


def last_id(history: DataFrame) -> int:
    return history.agg(F.max("report_id")).first()[0] or 0


def stored_rows(scored: DataFrame, start: int, arrival: list) -> DataFrame:
    """Triaged reports as they are stored: new ids in arrival order, final risk as label."""
    labelled = _rounded_mortality(scored).withColumn("risk_level", F.col("final_risk"))
    kept = [F.col(f.name).cast(f.dataType) for f in schema.REPORTS.fields if f.name != "report_id"]
    extra = [c for c in arrival if c not in {f.name for f in schema.REPORTS.fields}]
    renumbered = numbered(labelled.select(*kept, *extra), arrival, "report_id", start)
    return renumbered.select(*schema.REPORTS.fieldNames())


def appended(history: DataFrame, scored: DataFrame, arrival: list) -> DataFrame:
    """History with the triaged reports added under the next free ids."""
    return union_reports(history, stored_rows(scored, last_id(history) + 1, arrival))


def renumbered_by_date(reports: DataFrame) -> DataFrame:
    """Reports with ids 1, 2, ... in date order (old id breaks ties)."""
    old = reports.withColumnRenamed("report_id", "_old")
    return numbered(old, ["date", "_old"], "report_id").drop("_old").select(*reports.columns)
