from datetime import date

from pyspark.sql import functions as F

from herdlens.operators import dashboard, risk, skew
from herdlens.session import new_path
from herdlens.sources import tables


def test_csv_and_parquet_round_trip(spark, make_reports):
    reports = make_reports([{"temperature": None, "notes": "seen"}, {"symptom_fever": True}])
    for fmt, by_date in (("csv", False), ("parquet", True)):
        path = new_path(spark, "t")
        tables.write_reports(reports, path, fmt, by_date)
        back = tables.read_reports(spark, path, fmt).select(*reports.columns)
        assert [r.symptom_fever for r in back.orderBy("report_id").collect()] == [False, True]
        assert [r.temperature for r in back.orderBy("report_id").collect()] == [None, 38.5]


def test_date_filter_prunes_folders(spark, make_reports):
    path = new_path(spark, "t")
    tables.write_reports(make_reports([{"date": date(2026, 1, d)} for d in (1, 2, 3)]), path)
    shown = dashboard.filter_reports(tables.read_reports(spark, path), start="2026-01-02", end="2026-01-02")
    assert shown.count() == 1
    assert "PartitionFilters: [isnotnull(date" in shown._jdf.queryExecution().executedPlan().toString()


def test_nan_is_read_as_null(spark):
    df = tables.without_nan(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert [r.x for r in df.collect()] == [None, 1.0]


def test_append_numbers_on_from_the_last_id(spark, make_reports):
    history = make_reports([{"report_id": 41}, {"report_id": 7}])
    scored = make_reports([
        {"date": date(2026, 2, 2), "number_affected": 160, "number_deaths": 1},
        {"date": date(2026, 2, 1), "number_affected": 3, "number_deaths": 1},
    ]).withColumnRenamed("report_id", "arrival").withColumn("final_risk", F.lit("HIGH"))
    out = tables.appended(history, scored, ["date", "arrival"]).where("report_id > 41").orderBy("report_id").collect()
    assert [(r.report_id, r.date.day, r.mortality_rate, r.risk_level) for r in out] == [
        (42, 1, 0.3333, "HIGH"), (43, 2, 0.0063, "HIGH"),
    ]


def test_renumbering_follows_dates(make_reports):
    rows = make_reports([{"report_id": 10 - i, "date": date(2026, 1, 1 + i % 3)} for i in range(9)]).repartition(5)
    out = tables.renumbered_by_date(rows).orderBy("report_id").collect()
    assert [r.report_id for r in out] == list(range(1, 10))
    assert [r.date for r in out] == sorted(r.date for r in out)


def test_earlier_rows_across_blocks(spark):
    rows = [(i, "a" if i % 4 else "b", i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "n long, k string, v long")
    got = {r.n: r.s for r in skew.earlier_rows(df, ["k"], "n", {"s": "v"}, block=7).collect()}
    assert got == {n: sum(v for m, j, v in rows if j == k and m < n) for n, k, _ in rows}


def test_empty_selection_gives_empty_views(make_reports):
    reports = make_reports([{}])
    nothing = dashboard.filter_reports(reports, species=["goat"])
    scored = risk.region_risk(nothing, "village")
    assert tuple(dashboard.kpis(nothing, scored).first()) == (0, 0, 0, 0, 0)
    row = dashboard.shown_of_total(nothing, reports).first()
    assert (row.shown, row.total, row.as_of) == (0, 1, date(2026, 1, 5))
    assert dashboard.daily_trend(nothing).count() == 0


def test_recent_reports_latest_first(make_reports):
    rows = make_reports([{"date": date(2026, 1, 1 + i)} for i in range(9)])
    assert [r.date.day for r in dashboard.recent_reports(rows, n=3).collect()] == [9, 8, 7]


def test_histogram_of_equal_scores(spark):
    flat = spark.createDataFrame([("A", 10.0), ("B", 10.0)], "village string, risk_score double")
    rows = dashboard.score_histogram(flat).collect()
    assert len(rows) == 20 and sum(r.n for r in rows) == 2 and rows[0].low == 9.5
