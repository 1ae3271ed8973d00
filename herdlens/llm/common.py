"""Helpers that several text operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20  # text that a Python worker holds at once, one longer row aside


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Ready for Python tasks: Arrow batches bounded by bytes, as rows may be very long
    texts (a lower bound that is set already stays), and the folder of this package on
    the path of local workers. (On a cluster the package is installed or shipped with
    ``--py-files``.)
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths and not root.endswith((".zip", ".egg")):
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` beside the named columns.

    Names inside and outside the struct cannot clash, whatever ``df`` has.
    """
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
