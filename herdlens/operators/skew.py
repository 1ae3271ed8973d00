"""Work that stays spread out however the keys are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdlens.session import materialize

TASK_ROWS = 250_000  # rows of a task that sorts them for a window


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides.

    For tables that grow with the rows: whatever their size, none is collected by the
    driver to be broadcast, and what is shuffled grows in step with them.
    """
    return df.hint("merge")


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: list, how: str = "left", broadcasts: bool = True
) -> DataFrame:
    """Join ``facts`` to a ``lookup`` with one row per key, however many facts a key has.

    The lookup is written first. Both sides then have a shuffle of their own
    right below the join, which is what adaptive execution needs to split the
    facts of a hot key over tasks, each with that key's one row. (Joined
    straight from its aggregation, the lookup would bring its partitioning
    along and the join could not be split.) Lookups that grow with the facts are joined
    without ``broadcasts``.
    """
    written = materialize(lookup, "lookup")
    return facts.join(written if broadcasts else shuffled(written), keys, how)


def numbered(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """Number all rows by ``order`` without sending them through one task.

    Rows are range-sorted once and written with their partition and place in
    it; partition sizes (one row per partition) give each partition's offset.
    """
    ordered = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(ordered, "numbered")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + position + start).cast("bigint"))
        .drop("_place", "_part", "_offset")
    )


def tasks_for(df: DataFrame, rows: int) -> int:
    """Into how many tasks to deal ``rows`` of ``df``: what adaptive execution puts together goes by compressed bytes,
    and rows that compress well would fill a task's memory with their number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def earlier_rows(
    df: DataFrame, keys: list, order: str, measures: dict, block: int = 65536, tasks: int | None = None
) -> DataFrame:
    """Running sums over the rows of a key that come before a row's ``order``.

    ``order`` is a whole number, unique per row and dense. A key is cut into
    blocks of ``block`` order values: sums within a block use a window of at
    most that many rows, sums of earlier blocks one row per block.
    ``measures`` maps a new column to the column it sums. ``tasks`` is how many the
    windows are dealt to, at least, where that is not left to adaptive execution.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    if tasks is not None:
        cut = cut.repartition(tasks, *keys, "_block")
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    before = blocks.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_block").alias("_key_block"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), zero).alias(f"_before_{n}") for n in measures],
    )
    same = F.col("_block") == F.col("_key_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = cut.withColumns(
        {f"_in_{n}": F.coalesce(F.sum(c).over(within), zero) for n, c in measures.items()}
    ).join(before, same, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{n}") + F.coalesce(f"_before_{n}", zero)).alias(n) for n in measures],
    )


def least_before(df: DataFrame, keys: list, order: str, value: str, name: str, block: int = 65536) -> DataFrame:
    """The least ``value`` among the rows of a key that come before a row's ``order``, null for the first.

    A key is cut into blocks of ``order`` as in :func:`earlier_rows`.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "_block").agg(F.min(value).alias("_low"))
    before = blocks.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_block").alias("_key_block"),
        F.min("_low").over(earlier).alias("_low_before"),
    )
    same = F.col("_block") == F.col("_key_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = cut.withColumn("_low_in", F.min(value).over(within)).join(before, same, "left")
    return joined.select(*df.columns, F.least("_low_in", "_low_before").alias(name))
