"""Steps that have to stay cheap as tables grow: what is read once, sent on or held at a time."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import queries as catalog_queries
from herdlens.operators import arrival, order_stats, skew
from herdlens.plans import training
from herdlens.sources import driver_tables


def _worked_out(spark, n):
    """``n`` rows whose value counts each time that it is worked out."""
    count = spark.sparkContext.accumulator(0)

    def value(i):
        count.add(1)
        return float(i * 7919 % 104729)

    df = spark.range(n).select(F.lit("a").alias("name"), F.udf(value, T.DoubleType())("id").alias("value"))
    return df, count


def test_passes_of_order_statistics_work_out_each_value_once(spark):
    df, count = _worked_out(spark, 3000)
    values = sorted(float(i * 7919 % 104729) for i in range(3000))
    assert order_stats.order_statistics(df, lambda *_: {1700}) == {("a", 1700): values[1700]}
    assert count.value == 3000


def test_passes_of_medians_work_out_each_value_once(spark):
    df, count = _worked_out(spark, 3001)
    values = sorted(float(i * 7919 % 104729) for i in range(3001))
    assert order_stats.exact_medians(df, ["value"]) == {"value": values[1500]}
    assert count.value == 3001


def test_middle_values_far_apart_end_the_search(spark, monkeypatch):
    calls, counted = [], order_stats._counted

    def few(*args):
        calls.append(1)
        assert len(calls) < 10
        return counted(*args)

    monkeypatch.setattr(order_stats, "_counted", few)
    low = [i * 1e-9 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in [*low, *[100.0 + i for i in range(500)]]], "a double")
    assert order_stats.exact_medians(df, ["a"]) == {"a": (low[-1] + 100.0) / 2.0}


def test_training_rows_are_dealt_evenly(spark):
    rows = spark.range(4000).select(F.lit(None).cast("bigint").alias("report_id"), (F.col("id") * 7 % 4001).alias("x"))
    spread = training._spread(rows.coalesce(1))
    sizes = [r.n for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 4000
    assert max(sizes) < 2 * min(sizes)


def test_running_counts_deal_their_rows_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    rows = spark.range(300).select(
        F.concat(F.lit("V"), F.col("id") % 7).alias("village"), F.col("id").alias("arrived"),
        F.expr("date_add(DATE'2024-01-01', int(id % 3))").alias("date"),
    )
    probes, one = rows.withColumn("back", F.lit(0)), 300
    dealt = arrival._before(rows, probes, arrival.BLOCK, 50 * one)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert skew.tasks_for(rows, 50 * one) == 150
    found = {r.arrived: r.before for r in dealt.collect()}
    assert found == {i: len(range(i % 21, i, 21)) for i in range(300)}


@pytest.mark.parametrize("same_id", [False, True])
def test_labels_of_one_row_group_are_worked_out_by_many_tasks(spark, tmp_path, monkeypatch, same_id):
    day = datetime.datetime(2024, 1, 1)
    rows = [(None if same_id else i, day, i % 50, "view", float(i % 90), f'{{"k": {i % 100}}}') for i in range(2000)]
    events = spark.createDataFrame(rows, driver_tables.EVENTS).coalesce(1)
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"N{i}", 0) for i in range(25)], driver_tables.NATION).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], driver_tables.REGION).write.parquet(f"{tmp_path}/region.parquet")
    sizes, write = [], catalog_queries.materialize

    def written(df, name):
        sizes.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return write(df, name)

    monkeypatch.setattr(catalog_queries, "materialize", written)
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # which puts small tasks together
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        split = catalog_queries.win_stratified_split(spark, str(tmp_path))
        assert split.columns == ["report_id", "risk_level", "is_train"] and split.count() == 2000
    finally:
        spark.conf.set(name, before)
    assert len(sizes) > 1 and sum(sizes) == 2000 and max(sizes) < 1000
