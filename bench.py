"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import queries as Q  # noqa: E402
from herdlens.operators import context, outbreak  # noqa: E402
from herdlens.session import local_session  # noqa: E402


def written(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def headline() -> dict:
    def mixture(spark, sf):
        return outbreak.grade_severity(Q.reports(spark, sf))[0]

    def clusters(spark, sf):
        return outbreak.cluster_summary(Q.clustered.fresh(spark, sf))

    def training(spark, sf):
        return Q.trained.fresh(spark, sf).metrics

    return {
        "village_risk": Q.risk_village,
        "all_risk_levels": Q.risk_all_levels,
        "context_windows": lambda spark, sf: context.with_context(Q.reports(spark, sf)),
        "rules": Q.pred_rules,
        "report_reasons": Q.proj_explain_report,
        "validation": Q.pred_validate,
        "kpi": Q.agg_kpi,
        "daily_trend": Q.agg_daily_trend,
        "recent_reports": Q.topk_recent_reports,
        "hotspot_markers": Q.proj_marker,
        "batch_context": Q.win_context_batch,
        "st_dbscan": clusters,
        "severity_mixture": mixture,
        "forest_300_trees": training,
        "stream_triage": Q.stream_triage,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    written(Q.reports(spark, sf_dir).agg(F.max("report_id")))  # start the workers
    times = {}
    for name, query in headline().items():
        start = time.time()
        written(query(spark, sf_dir))
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
