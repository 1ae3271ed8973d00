import random
from datetime import date, timedelta

from herdlens.operators import context


def _rows(n=120, seed=1):
    rnd = random.Random(seed)
    rows = [
        {
            "village": rnd.choice(["A", "A", "A", "B", "C"]),
            "date": date(2026, 1, 1) + timedelta(days=rnd.randrange(40)),
            "risk_level": rnd.choice(["LOW", "MEDIUM", "HIGH"]),
        }
        for _ in range(n)
    ]
    return [r | {"report_id": i + 1} for i, r in enumerate(rows)]


def naive(history, village, day, exclude=None):
    """Counts by looking at every row."""
    same = [h for h in history if h["village"] == village and h["report_id"] != exclude]
    age = [((day - h["date"]).days, h["risk_level"] == "HIGH") for h in same]
    recent = sum(0 <= a <= 6 for a, _ in age)
    previous = sum(7 <= a <= 13 for a, _ in age)
    high = sum(h for a, h in age if a > 0)
    velocity = round(recent / previous if previous else float(recent), 3)
    return (recent, previous, high, velocity, sum(0 <= a <= 2 for a, _ in age) >= 3)


def _values(row):
    return tuple(row[c] for c in context.CONTEXT_COLUMNS)


def test_context_equals_naive_counts(make_reports):
    rows = _rows()
    got = {r.report_id: _values(r) for r in context.with_context(make_reports(rows)).collect()}
    assert got == {r["report_id"]: naive(rows, r["village"], r["date"], r["report_id"]) for r in rows}


def test_context_does_not_depend_on_partitions(make_reports):
    reports = make_reports(_rows())
    assert sorted(context.with_context(reports.repartition(1)).collect()) == sorted(
        context.with_context(reports.repartition(7)).collect()
    )


def test_history_context(make_reports):
    rows = _rows()
    history, new = rows[:80], rows[80:]
    got = context.with_history_context(
        make_reports(new).drop("risk_level"), make_reports(history)
    ).collect()
    assert {r.report_id: _values(r) for r in got} == {r["report_id"]: naive(history, r["village"], r["date"]) for r in new}


def test_targets_with_an_excluded_report(spark, make_reports):
    rows = _rows()
    targets = [(r["village"], r["date"] + timedelta(days=i % 9), r["report_id"]) for i, r in enumerate(rows)]
    asked = spark.createDataFrame(targets, "village string, date date, exclude_report_id bigint")
    got = context.village_context(make_reports(rows), asked).collect()
    assert {(r.village, r.date, r.exclude_report_id): _values(r) for r in got} == {
        t: naive(rows, t[0], t[1], t[2]) for t in targets
    }


def test_missing_village_has_no_context(make_reports):
    rows = [{"village": None}, {"village": None}, {"village": "A"}, {"village": "A"}]
    got = {r.report_id: r.recent_reports for r in context.with_context(make_reports(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_without_labels_there_is_no_history(make_reports):
    got = context.with_context(make_reports(_rows()).drop("risk_level"))
    assert got.where("historical_incidence > 0").count() == 0


def test_skewed_village_day_is_split(spark, make_reports):
    """The join back to the reports is one that adaptive execution can split."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    rows = [{"village": "A"}] * 3000 + [{"village": f"V{i}"} for i in range(300)]
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        out = context.with_context(make_reports(rows).repartition(8))
        assert out.where("recent_reports = 2999").count() == 3000
        kept = out.select("report_id", "recent_reports", "notes")
        kept.collect()
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
