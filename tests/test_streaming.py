import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from catalog.queries import label_scorer
from herdlens import schema
from herdlens.operators.arrival import chain_steps, past_counts, span_counts
from herdlens.plans.triage import prepare
from herdlens.session import new_path, work_dir
from herdlens.streaming import trends, triage
from herdlens.streaming.triage import TriageStream
from tests.test_context import naive

START = date(2026, 3, 1)


def _arrivals(make_reports, n=24):
    rows = [
        {
            "village": "A" if i % 3 else "B",
            "date": START + timedelta(days=i // 8),
            "number_affected": 4 + i % 9, "number_deaths": 2 if i % 7 == 0 else 0,
            "symptom_fever": i % 2 == 0,
        }
        for i in range(n)
    ]
    rows[5]["species"] = "dragon"
    return make_reports(rows)


@pytest.fixture(scope="module")
def history(make_reports):
    return make_reports([
        {"report_id": 100 + i, "village": "A", "date": START - timedelta(days=1 + i), "risk_level": "HIGH" if i == 1 else "LOW"}
        for i in range(4)
    ])


def _run(spark, history, arrivals, batches, folder=None):
    """Feed the arrivals in ``batches`` groups of whole days."""
    folder = folder or new_path(spark, "triage")
    stream = TriageStream(spark, folder, label_scorer)
    stream.start_from(history)
    incoming = arrivals.drop("mortality_rate", "risk_level").withColumnRenamed("report_id", "arrival")
    for i, days in enumerate(batches):
        stream.process(incoming.where(F.col("date").isin([START + timedelta(days=d) for d in days])), i)
    return stream


def _rows(stream):
    return [
        (r.report_id, r.village, r.date, r.risk_level, r.rule_name, *r.context)
        for r in stream.accepted().orderBy("report_id").collect()
    ]


def test_batches_do_not_change_the_result(spark, make_reports, history, monkeypatch):
    monkeypatch.setattr(triage, "COMPACT_EVERY", 2)
    arrivals = _arrivals(make_reports)
    one = _run(spark, history, arrivals, [[0, 1, 2]])
    three = _run(spark, history, arrivals, [[0], [1], [2]])
    assert _rows(one) == _rows(three)
    assert [r[0] for r in _rows(one)] == list(range(104, 104 + 23))
    assert one.rejected().count() == 1


def test_equal_to_one_report_at_a_time(spark, make_reports, history):
    arrivals = _arrivals(make_reports)
    got = _rows(_run(spark, history, arrivals, [[0, 1], [2]]))
    known = [{"report_id": r.report_id, "village": r.village, "date": r.date, "risk_level": r.risk_level} for r in history.collect()]
    features = prepare(arrivals.where("species <> 'dragon'").drop("risk_level"))
    labelled = {r.report_id: r.ml_prediction for r in label_scorer(features).collect()}
    for mine, row in zip(got, sorted(arrivals.where("species <> 'dragon'").collect(), key=lambda r: r.report_id)):
        values = naive(known, row.village, row.date)
        assert mine[5:] == values
        risk = "HIGH" if mine[4] else labelled[row.report_id]
        assert mine[3] == risk and (mine[4] == "rapid_spread" or not values[4] or mine[4] is not None)
        known.append({"report_id": mine[0], "village": row.village, "date": row.date, "risk_level": risk})


def test_a_repeated_batch_replaces_itself(spark, make_reports, history):
    arrivals = _arrivals(make_reports)
    stream = _run(spark, history, arrivals, [[0], [1, 2]])
    before = _rows(stream)
    incoming = arrivals.drop("mortality_rate", "risk_level").withColumnRenamed("report_id", "arrival")
    stream.process(incoming.where(F.col("date") > START), 1)
    assert _rows(stream) == before


def test_restart_from_checkpoint_adds_nothing(spark, make_reports, history):
    source, folder = new_path(spark, "in"), new_path(spark, "triage")
    incoming = _arrivals(make_reports).drop("mortality_rate", "risk_level").withColumnRenamed("report_id", "arrival")
    incoming.coalesce(1).write.parquet(source)
    stream = TriageStream(spark, folder, label_scorer)
    stream.start_from(history)
    for _ in range(2):
        stream.run(spark.readStream.schema(incoming.schema).parquet(source)).awaitTermination(120)
    assert stream.accepted().count() == 23


def test_streamed_totals_equal_batch(spark, make_reports):
    source = new_path(spark, "in")
    reports = _arrivals(make_reports)
    reports.repartition(3).write.parquet(source)
    read = spark.readStream.schema(schema.REPORTS).option("maxFilesPerTrigger", 1).parquet(source)
    updates = trends.daily_trend_stream(read)
    folder = new_path(spark, "trend")
    trends.run_updates(updates, folder).awaitTermination(120)
    got = {r.date: r.reports for r in trends.current(spark, folder, updates, ["date"]).collect()}
    assert got == {START + timedelta(days=d): 8 for d in range(3)}

    spreading = trends.rapid_spread_stream(read, min_reports=4)
    folder = new_path(spark, "rapid")
    trends.run_updates(spreading, folder).awaitTermination(120)
    rows = trends.current(spark, folder, spreading, ["village", "date"]).collect()
    dates = [(r.village, r.date) for r in reports.select("village", "date").collect()]
    want = {}
    for village in ("A", "B"):
        for shift in range(6):
            day = START + timedelta(days=shift)
            n = sum(v == village and 0 <= (day - d).days <= 2 for v, d in dates)
            if n >= 4:
                want[village, day] = n
    assert {(r.village, r.date): r.n for r in rows} == want


def test_steps_follow_the_busiest_village(spark, make_reports, history):
    """Sixty dates in a batch, no village with more than three of them: three steps."""
    rows = [
        {"village": f"W{i % 20}", "date": START + timedelta(days=i), "number_affected": 5, "number_deaths": i % 3}
        for i in range(60)
    ]
    stream = _run(spark, history, make_reports(rows), [range(60)])
    found = stream.spark.read.parquet(f"{stream.folder}/accepted").select("step").distinct()
    assert sorted(r.step for r in found.collect()) == [0, 1, 2]
    assert [r[0] for r in _rows(stream)] == list(range(104, 164))


def test_nothing_but_rejected_reports(spark, make_reports, history):
    arrivals = make_reports([{"species": "heron", "date": START}, {"village": "", "date": START}])
    stream = _run(spark, history, arrivals, [[0]])
    assert stream.accepted().count() == 0 and "final_risk" in stream.accepted().columns
    assert stream.rejected().count() == 2


def _longest_chains(rows):
    """Step of each (village, day, arrived): reports of the longest chain before it."""
    out = {}
    for village, day, arrived in sorted(rows, key=lambda r: r[2]):
        before = [s for (v, d, _), s in out.items() if v == village and d < day]
        out[village, day, arrived] = max(before, default=-1) + 1
    return {arrived: s for (_, _, arrived), s in out.items()}


@pytest.mark.parametrize("block", [4, 65536])
def test_steps_are_the_longest_chains(spark, block):
    rng = random.Random(block)
    rows = [("A" if i % 3 else "B", rng.randrange(9), i) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "village string, day int, arrived long").selectExpr(
        "village", "date_from_unix_date(day) AS date", "arrived"
    ).repartition(3)
    steps, n = chain_steps(df, block)
    expected = _longest_chains(rows)
    assert {r.arrived: r.step for r in steps.collect()} == expected and n == max(expected.values()) + 1
    none, n = chain_steps(df.limit(0))
    assert none.count() == 0 and n == 0


@pytest.mark.parametrize("block", [4, 65536])
def test_counts_of_earlier_arrivals(spark, block):
    rng = random.Random(7)
    rows = [(rng.choice("AB"), rng.randrange(25), i, rng.random() < 0.4) for i in range(80)]
    df = spark.createDataFrame(rows, "village string, day int, arrived long, high boolean").selectExpr(
        "village", "date_from_unix_date(day) AS date", "arrived", "high"
    )
    spans = {r.arrived: (r.in_recent, r.in_previous, r.in_rapid) for r in span_counts(df.drop("high"), block=block).collect()}
    past = {r.arrived: r.in_past for r in past_counts(df.drop("high"), df.where("high"), block).collect()}
    for v, d, a, _ in rows:
        ages = [(d - d2, h) for v2, d2, a2, h in rows if v2 == v and a2 < a]
        assert spans[a] == tuple(sum(lo <= x <= hi for x, _ in ages) for lo, hi in ((0, 6), (7, 13), (0, 2)))
        assert past.get(a, 0) == sum(x > 0 and h for x, h in ages)


def _past_scorer(df):
    """A class that depends on the past, so that the order of judging matters."""
    return df.withColumns({
        "ml_prediction": F.when(F.col("historical_incidence") % 2 == 0, "HIGH").otherwise("LOW"), "ml_confidence": F.lit(1.0),
        "ml_probabilities": F.create_map(F.lit("HIGH"), F.lit(1.0)),
    })


@pytest.mark.parametrize("cuts", [[60], [25, 60]])
def test_any_arrival_order_equals_one_report_at_a_time(spark, make_reports, history, cuts):
    rng = random.Random(5)
    rows = [
        {"village": rng.choice("AAB"), "date": START + timedelta(days=rng.randrange(-3, 9)), "number_affected": 20, "number_deaths": 0}
        for _ in range(cuts[-1])
    ]
    arrivals = make_reports(rows).drop("mortality_rate", "risk_level").withColumnRenamed("report_id", "arrival").repartition(3)
    stream = TriageStream(spark, new_path(spark, "triage"), _past_scorer)
    stream.start_from(history)
    for i, (first, last) in enumerate(zip([0, *cuts], cuts)):
        stream.process(arrivals.where((F.col("arrival") > first) & (F.col("arrival") <= last)), i)
    got = _rows(stream)
    known = [{"report_id": r.report_id, "village": r.village, "date": r.date, "risk_level": r.risk_level} for r in history.collect()]
    assert len(got) == len(rows)
    for mine, row in zip(got, rows):
        values = naive(known, row["village"], row["date"])
        risk = "HIGH" if values[4] or values[2] % 2 == 0 else "LOW"
        assert (mine[1], mine[2], mine[3]) == (row["village"], row["date"], risk) and mine[5:] == values
        known.append({"report_id": mine[0], "village": row["village"], "date": row["date"], "risk_level": risk})
    assert {"HIGH", "LOW"} == {m[3] for m in got}


def test_intermediate_tables_of_a_batch_are_removed(spark, make_reports, history):
    folder = f"{work_dir(spark)}/herdlens".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    stream = _run(spark, history, _arrivals(make_reports), [[0], [1, 2]], folder=f"{new_path(spark, 'triage')}")
    left = {name for name in set(os.listdir(folder)) - before if not name.startswith("triage-")}
    assert not left and stream.accepted().count() == 23
