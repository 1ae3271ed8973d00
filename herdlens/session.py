"""Session settings and tables written between the steps of iterative work."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "herdlens") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", "/tmp/herdlens-warehouse")  # the one disk of a local session
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset it lies
    in the warehouse, which all executors reach as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    folder = _scope.get() or f"{work_dir(spark).rstrip('/')}/herdlens"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the intermediate tables written inside; it is gone afterwards.

    For work that ends with its results written elsewhere: nothing that is still
    to be computed may read these tables.
    """
    folder = new_path(spark, "scratch")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        _remove(spark, folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the following
    plans columnar scans with true sizes to choose their joins by.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
