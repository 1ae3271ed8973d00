"""Reports in the order of their arrival, whatever their dates.

A report sees what arrived before it. How many of those fall into a span of days is
a count over two orders, arrival and day: each report asks the days of its span, and
a running count along the arrivals of each village and day answers. Its past, in
contrast, depends on how the earlier reports were judged, so reports are judged in
steps: a report's step is the longest chain of reports of its village, each arrived
and dated before the next, that leads to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from herdlens.config import DEFAULT, Config
from herdlens.operators.skew import earlier_rows, least_before, lookup_join, tasks_for
from herdlens.session import materialize

BLOCK = 65536  # arrivals of a village that one window holds


def chain_steps(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``(arrived, step)`` of ``(village, date, arrived)``, and how many steps there are.

    The reports that no earlier arrival with an earlier date precedes are one step;
    those of what is left are the next, so steps are as many as the longest chain has
    reports. ``arrived`` numbers all rows.
    """
    left = materialize(rows.select("village", "arrived", F.unix_date("date").alias("day")), "arrivals")
    found = None
    step = 0
    while True:
        seen = Observation()
        low = least_before(left, ["village"], "arrived", "day", "low", block)
        marked = low.withColumn("ready", F.coalesce(F.col("low") >= F.col("day"), F.lit(True)))
        marked = materialize(
            marked.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ready")).alias("waiting")), "arrivals"
        )
        ready = marked.where("ready").select("arrived", F.lit(step).alias("step"))
        found = ready if found is None else found.unionByName(ready)
        counts = seen.get
        if not counts["waiting"]:
            return materialize(found, "arrival-steps"), step + bool(counts["n"])
        left, step = marked.where("NOT ready").select("village", "arrived", "day"), step + 1


def _before(events: DataFrame, probes: DataFrame, block: int, rows: int) -> DataFrame:
    """``probes`` with ``before``: the events of their village and date that arrived earlier; ``rows`` is how many there are."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    told = [c for c in probes.columns if c not in ("village", "date", "arrived")]
    # A report asks just before it counts itself.
    asked = probes.withColumns({"_n": none, "_asks": F.lit(True), "_at": 2 * F.col("arrived")})
    both = events.select("village", "date", "arrived").withColumns(
        {"_n": one, "_asks": F.lit(False), "_at": 2 * F.col("arrived") + 1}
    )
    for c in told:
        both = both.withColumn(c, F.lit(None).cast(probes.schema[c].dataType))
    counted = earlier_rows(both.unionByName(asked), ["village", "date"], "_at", {"before": "_n"}, block, tasks_for(probes, rows))
    return counted.where("_asks").select(*probes.columns, "before")


def span_counts(rows: DataFrame, cfg: Config = DEFAULT, block: int = BLOCK) -> DataFrame:
    """``(arrived, in_recent, in_previous, in_rapid)``: earlier arrivals of the village in the spans up to a report's date."""
    short = cfg.short_days
    back = F.explode(F.sequence(F.lit(0), F.lit(2 * short - 1)))
    asked = rows.select("village", "arrived", "date", back.alias("back"))
    probes = asked.select("village", F.expr("date_sub(date, back)").alias("date"), "arrived", "back")
    counted = _before(rows, probes, block, rows.count() * 2 * short)

    def total(span: Column) -> Column:
        return F.sum(F.when(span, F.col("before")).otherwise(F.lit(0).cast("bigint")))

    return counted.groupBy("arrived").agg(
        total(F.col("back") < short).alias("in_recent"),
        total(F.col("back") >= short).alias("in_previous"),
        total(F.col("back") < cfg.rapid_window_days).alias("in_rapid"),
    )


def past_counts(rows: DataFrame, events: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(arrived, in_past)``: the ``events`` of a report's village that arrived and are dated before it."""
    days = events.groupBy("village").agg(F.array_sort(F.collect_set("date")).alias("days"))  # days of one micro-batch
    asked = lookup_join(rows.select("village", "arrived", F.col("date").alias("own")), days, ["village"], "inner")
    probes = asked.select("village", F.explode("days").alias("date"), "arrived", "own").where("date < own").drop("own")
    most = rows.count() * events.agg(F.count_distinct("date")).first()[0]
    return _before(events, probes, block, most).groupBy("arrived").agg(F.sum("before").alias("in_past"))
