"""Triage of reports as they arrive.

Each micro-batch is checked, scored against everything that arrived before it
and appended to the folder's tables:

* ``accepted`` - stored reports with their triage result,
* ``rejected`` - invalid reports with their messages,
* ``daily`` - each batch's report counts per village and day, combined into
  ``base`` every ``COMPACT_EVERY`` batches. These counts are the only history
  that scoring a batch reads.

Within a batch, reports arrive in the order of the arrival column, whatever their
dates: each sees the reports that arrived before it and no others. The past of a
report depends on the final risk of earlier arrivals with earlier dates, so a batch
is judged in as many steps as the longest chain of those (``operators/arrival``),
all villages side by side; counts of recent reports need no steps.
All writes go to folders named by batch and step, and reads look at earlier
ones only, so a repeated batch replaces itself. Intermediate tables of a batch are
removed with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdlens import schema
from herdlens.config import DEFAULT, Config
from herdlens.operators.arrival import chain_steps, past_counts, span_counts
from herdlens.operators.context import daily_counts, named_context, with_counts
from herdlens.operators.features import with_mortality
from herdlens.operators.skew import numbered
from herdlens.operators.validation import split_valid
from herdlens.plans.triage import RESULT_COLUMNS, Scorer, judge, prepare
from herdlens.session import materialize, scratch
from herdlens.sources.tables import last_id

COMPACT_EVERY = 100

_DAILY = "village string, date date, n bigint, n_high bigint"


@dataclass(frozen=True)
class TriageStream:
    spark: SparkSession
    folder: str
    scorer: Scorer
    arrival: str = "arrival"
    cfg: Config = DEFAULT

    def start_from(self, history: DataFrame) -> None:
        """Write the history's daily counts and last id; later batches build on them."""
        daily_counts(history).write.mode("overwrite").parquet(self._base(0))
        self._write(self.spark.range(1).select(F.lit(last_id(history)).alias("last_id")), "ids", -1, 0)

    def run(self, incoming: DataFrame, **trigger) -> StreamingQuery:
        return (
            incoming.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint")
            .foreachBatch(self.process)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        with scratch(self.spark):
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        valid, rejected = split_valid(batch, self.cfg)
        self._write(rejected, "rejected", batch_id, 0)
        columns = [f.name for f in schema.INCOMING.fields]
        last = self.spark.read.schema("last_id bigint").parquet(self._path("ids", batch_id - 1, 0))
        first_free = last.first().last_id + 1
        prepared = prepare(valid.select(*columns, self.arrival), self.cfg)
        # Reports that arrive at once are told apart by their contents, so that a repeated batch numbers them alike.
        ties = [F.xxhash64(*columns), *columns]
        rows = materialize(numbered(prepared, [self.arrival, *ties], "report_id", first_free), "arrived")
        if batch_id and batch_id % COMPACT_EVERY == 0:
            self._compact(batch_id)
        arrivals = rows.select("village", "date", F.col("report_id").alias("arrived"))
        levels, steps = chain_steps(arrivals)
        in_batch = span_counts(arrivals, self.cfg).join(levels, "arrived").withColumnRenamed("arrived", "report_id")
        counted = with_counts(rows, self._daily_before(batch_id), self.cfg).join(in_batch, "report_id")
        counted = counted.withColumns(
            {f"_{c}": F.coalesce(f"_{c}", F.lit(0)) + F.col(f"in_{c}") for c in ("recent", "previous", "rapid")}
        ).drop("in_recent", "in_previous", "in_rapid")
        counted = materialize(counted, "counted")
        done: list = []
        for step in range(max(1, steps)):  # one also for a batch without valid reports
            today = counted.where(F.col("step") == step).drop("step")
            if done:
                high = self.spark.read.schema(kind).parquet(*done).where("risk_level = 'HIGH'")
                events = high.select("village", "date", F.col("report_id").alias("arrived"))
                past = past_counts(today.select("village", "date", F.col("report_id").alias("arrived")), events)
                today = today.join(past.withColumnRenamed("arrived", "report_id"), "report_id", "left")
                today = today.withColumn("_history", F.coalesce("_history", F.lit(0)) + F.coalesce("in_past", F.lit(0)))
            known = named_context(today, rows.columns, F.lit(0), self.cfg)
            judged = judge(known, self.scorer, ["report_id", *columns], self.cfg)
            stored = with_mortality(judged, digits=4).withColumn("risk_level", F.col("final_risk"))
            accepted = stored.select(*schema.REPORTS.fieldNames(), *RESULT_COLUMNS)
            done.append(self._write(accepted, "accepted", batch_id, step))
            kind = accepted.schema
        self._write(daily_counts(self.spark.read.schema(kind).parquet(*done)), "daily", batch_id, 0)
        last = rows.agg(F.coalesce(F.max("report_id"), F.lit(first_free - 1)).alias("last_id"))
        self._write(last, "ids", batch_id, 0)

    def accepted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/accepted").drop("batch_id", "step")

    def rejected(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rejected").drop("batch_id", "step")

    def _path(self, table: str, batch_id: int, step: int) -> str:
        return f"{self.folder}/{table}/batch_id={batch_id}/step={step}"

    def _write(self, df: DataFrame, table: str, batch_id: int, step: int) -> str:
        path = self._path(table, batch_id, step)
        df.write.mode("overwrite").parquet(path)
        return path

    def _base(self, upto: int) -> str:
        return f"{self.folder}/base/upto={upto}"

    def _read_daily(self, start: int, batch_id: int) -> DataFrame:
        """Counts of the base at ``start`` and of the batches from there to the one before ``batch_id``."""
        paths = [self._base(start), *[self._path("daily", b, 0) for b in range(start, batch_id)]]
        return self.spark.read.schema(_DAILY).parquet(*paths)

    def _daily_before(self, batch_id: int) -> DataFrame:
        return self._read_daily(batch_id // COMPACT_EVERY * COMPACT_EVERY, batch_id)

    def _compact(self, batch_id: int) -> None:
        """Combine the counts of all earlier batches; a repeated batch writes the same."""
        earlier = self._read_daily(batch_id - COMPACT_EVERY, batch_id)
        combined = earlier.groupBy("village", "date").agg(F.sum("n").alias("n"), F.sum("n_high").alias("n_high"))
        combined.write.mode("overwrite").parquet(self._base(batch_id))
