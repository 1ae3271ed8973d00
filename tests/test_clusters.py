from datetime import date, timedelta

import numpy as np
import pytest

from herdlens.operators import outbreak, skew, stdbscan
from herdlens.operators.components import connected_components
from herdlens.session import materialize
from tests.brute import sequential_labels


def _labels(spark, points, eps_km, eps_days, min_samples, parts=3):
    df = spark.createDataFrame(
        [(i, float(a), float(b), int(d)) for i, (a, b, d) in enumerate(points)],
        "report_id long, latitude double, longitude double, day_offset int",
    ).repartition(parts)
    out = stdbscan.st_dbscan(df, eps_km, eps_days, min_samples)
    return [r.st_cluster for r in out.orderBy("report_id").collect()]


def _blob(rng, n, centre, spread, days):
    return np.column_stack(
        [rng.normal(centre[0], spread, n), rng.normal(centre[1], spread, n), rng.integers(0, days, n)]
    )


def test_dense_spot_among_strays(spark):
    # A ring of eleven places some 300 m wide, a day or two apart, and four strays.
    angle = np.linspace(0, 2 * np.pi, 11, endpoint=False)
    ring = np.column_stack([-33.5 + 0.0015 * np.sin(angle), 18.9 + 0.0015 * np.cos(angle), np.arange(11) % 3 + 40])
    strays = np.array([[-33.5, 19.9, 41], [-33.5, 18.9, 90], [51.0, 0.0, 41], [-20.0, 18.9, 40]])
    assert _labels(spark, np.vstack([strays, ring]), 1.0, 2, 7) == [-1] * 4 + [0] * 11


def test_two_seasons_at_one_well(spark):
    well = [(47.25, -101.5, day) for day in (3, 4, 4, 5, 6, 7, 7)] + [(47.25, -101.5, day) for day in (160, 161, 161, 162, 163)]
    assert _labels(spark, well, 0.5, 4, 5) == [0] * 7 + [1] * 5


@pytest.mark.parametrize("days", [0, 1, 7, 30])
def test_wide_windows_of_days(spark, days):
    rng = np.random.default_rng(21)
    points = np.vstack([_blob(rng, 90, (-1.3, 36.8), 0.03, 200), _blob(rng, 40, (-1.25, 36.9), 0.01, 60)])
    assert _labels(spark, points, 2.5, days, 4) == sequential_labels(points, 2.5, days, 4)


def test_rows_without_day_or_place_are_noise(spark):
    rows = [(i, 12.0, 77.0, None) for i in range(7)] + [(10 + i, 12.0, 77.0, 5) for i in range(6)]
    rows += [(30, None, 77.0, 5), (31, 12.0, float("nan"), 5), (32, None, None, None)]
    df = spark.createDataFrame(rows, "report_id long, latitude double, longitude double, day_offset int")
    got = {r.report_id: r.st_cluster for r in stdbscan.st_dbscan(df, 2.0, 2, 6).collect()}
    assert got == {i: 0 if 10 <= i < 16 else -1 for i, *_ in rows}


def test_many_places_are_counted_without_pairs(spark):
    rng = np.random.default_rng(8)
    n = 4000
    points = np.column_stack([np.arange(n), rng.uniform(45.0, 45.05, n), rng.uniform(7.0, 7.06, n), np.full(n, 3)])
    df = spark.createDataFrame([(int(i), float(a), float(b), int(d)) for i, a, b, d in points], "report_id long, latitude double, longitude double, day_offset int")
    hood = stdbscan.Neighbourhood.of(2.0, 2)
    cells = stdbscan.materialize(stdbscan.cells_of(df, "latitude", "longitude", "day_offset", "report_id", hood.grid), "cells")
    near = stdbscan.adjacent_boxes(cells, hood.grid)
    compared = []
    direct = stdbscan._Finer._direct
    try:
        def counted(self, open_pairs, level):
            out = direct(self, open_pairs, level)
            compared.append(out)
            return out

        stdbscan._Finer._direct = counted
        got = {r.first: r.near_weight for r in stdbscan.neighbour_weight(cells, near, hood).collect()}
    finally:
        stdbscan._Finer._direct = direct
    lat, lon = np.radians(points[:, 1]), np.radians(points[:, 2])
    for i in range(0, n, 400):  # great-circle distances, point by point
        h = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lon - lon[i]) / 2) ** 2
        assert got[i] == int((2 * 6371.0088 * np.arcsin(np.sqrt(h)) <= 2.0).sum())
    assert sum(c.count() for c in compared) < n * n / 8


def test_equal_to_sequential_labels(spark):
    rng = np.random.default_rng(31)
    points = np.vstack([_blob(rng, 110, (-12, -55), 0.035, 14), _blob(rng, 90, (-11.9, -55.1), 0.02, 9)])
    points = points[rng.permutation(len(points))]
    expected = sequential_labels(points, 2.0, 2, 5)
    assert len(set(expected)) > 2
    assert _labels(spark, points, 2.0, 2, 5, parts=1) == expected
    assert _labels(spark, points, 2.0, 2, 5, parts=6) == expected


def test_across_the_date_line(spark):
    rng = np.random.default_rng(3)
    points = _blob(rng, 150, (-40, 180), 0.05, 5)
    points[:, 1] = (points[:, 1] + 180) % 360 - 180
    assert _labels(spark, points, 3.0, 2, 5) == sequential_labels(points, 3.0, 2, 5)


def test_many_places_per_box_are_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(stdbscan, "DIRECT_PAIRS", 6)
    monkeypatch.setattr(stdbscan, "FACTOR", 2)
    rng = np.random.default_rng(4)
    points = np.vstack([_blob(rng, 160, (20, 74), 0.015, 3), _blob(rng, 40, (20.05, 74.03), 0.02, 3)])
    assert _labels(spark, points, 2.0, 1, 18) == sequential_labels(points, 2.0, 1, 18)


def test_no_rows_and_no_clusters(spark):
    assert _labels(spark, np.empty((0, 3)), 2.0, 2, 3) == []
    assert _labels(spark, [(60.1, 24.9, 8), (61.5, 23.8, 8)], 2.0, 2, 3) == [-1, -1]
    assert _labels(spark, [(60.1, 24.9, 8)] * 3, 2.0, 2, 3) == [0, 0, 0]


def test_components_with_a_hub(spark):
    edges = [(600, i) for i in range(150)] + [(900 + i, 901 + i) for i in range(25)] + [(9, 9), (925, 600)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0} and len(got) == 150 + 1 + 26


def test_lookup_join_is_split_where_a_key_is_hot(spark):
    facts = spark.range(60_000).selectExpr("id", "IF(id % 3 = 0, 7, id % 50) AS k", "repeat(cast(id AS string), 40) AS load")
    lookup = facts.groupBy("k").count().selectExpr("k", "k * 10 AS v")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = skew.lookup_join(facts, lookup, ["k"])
        rows = joined.collect()
        assert len(rows) == 60_000 and all(r.v == 10 * r.k for r in rows)
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _field(make_reports):
    """Nine deadly reports at one lake, eight mild ones along a river, and two single ones."""
    rows = [
        {"village": "Lake", "district": "North", "date": date(2025, 7, 10) + timedelta(days=i % 3), "number_affected": 5, "number_deaths": 2, "risk_level": "HIGH"}
        for i in range(9)
    ]
    rows += [
        {"village": f"River{i % 4}", "district": "South", "date": date(2025, 8, 2) + timedelta(days=i), "number_affected": 3}
        for i in range(8)
    ]
    rows += [{"village": "Hill", "district": "North", "date": date(2025, 7, 25)}, {"village": "nowhere", "date": date(2025, 7, 25)}]
    return make_reports(rows)


def _regions(spark):
    places = [("North", "N1", "Lake", 59.9, 30.3), ("North", "N1", "Hill", 61.2, 28.8), ("North", "N1", "unmapped", 60.0, None)]
    places += [("South", "S1", f"River{i}", 55.7, 37.6 + i * 0.002) for i in range(4)]
    return spark.createDataFrame(places, "district string, block string, village string, latitude double, longitude double")


def test_detection_end_to_end(spark, make_reports):
    found = outbreak.detect_outbreaks(_field(make_reports), _regions(spark), eps_days=3, min_samples=6)
    assert found.reports.count() == 18  # the report from nowhere has no coordinates
    lake, river = found.cluster_summary.collect()
    assert (lake.st_cluster, lake.villages, lake.total_deaths, lake.flagged_as_outbreak) == (0, "Lake", 18, True)
    assert (lake.duration_days, lake.scale, lake.mean_mortality_rate) == (3, "Localized outbreak", 0.4)
    assert (river.n_villages, river.villages, river.dominant_village) == (4, "River0, River1, River2...", "River0")
    assert (river.duration_days, river.scale) == (8, "Epidemic-scale (multi-village/district)")
    assert tuple(found.totals.first()) == (2, 1)
    assert [r.name for r in found.severity_groups.collect()] == ["Mild", "Moderate", "Severe"]
    known = spark.createDataFrame([("Lake",), ("Hill",)], "village string")
    checked = outbreak.validate_outbreaks(found.cluster_summary, known).first()
    assert (checked.true_positives, checked.false_positives, checked.false_negatives) == (1, 0, 1)
    assert (checked.precision, checked.recall) == (1.0, 0.5)


def test_detection_on_no_reports(spark, make_reports):
    found = outbreak.detect_outbreaks(make_reports([]), _regions(spark))
    assert found.reports.count() == found.cluster_summary.count() == found.severity_groups.count() == 0
    assert tuple(found.totals.first()) == (0, 0) and found.mixture is None
    assert "severity_group" in found.reports.columns


def test_no_cluster_gives_an_empty_typed_summary(spark, make_reports):
    clustered = outbreak.clustered_reports(make_reports([{"village": "Lake"}]), _regions(spark))
    summary = outbreak.cluster_summary(clustered)
    assert summary.count() == 0 and summary.columns == list(outbreak.SUMMARY_SCHEMA)


def _villages(spark):
    rows = [(i, 20.0 + 0.0095 * (i % 4), 78.0, i // 4) for i in range(80)]
    return spark.createDataFrame(rows, "report_id long, latitude double, longitude double, day_offset int")


def test_pairs_are_worked_out_once_where_no_box_is_crowded(spark, monkeypatch):
    written = []

    def noted(df, name):
        written.append(name)
        return materialize(df, name)

    monkeypatch.setattr(stdbscan, "materialize", noted)
    found = stdbscan.st_dbscan(_villages(spark), 2.0, 2, 6).groupBy("st_cluster").count().collect()
    assert [tuple(r) for r in found] == [(0, 80)]
    assert {"cells", "crowded"} <= set(written) and not {"count", "link", "border"} & set(written)


def test_tables_that_grow_with_the_reports_are_not_sent_through_the_driver(spark):
    hood = stdbscan.Neighbourhood.of(2.0, 2)
    cells = materialize(stdbscan.cells_of(_villages(spark), "latitude", "longitude", "day_offset", "report_id", hood.grid), "cells")
    near = materialize(stdbscan.adjacent_boxes(cells, hood.grid), "near")
    nodes = materialize(stdbscan.nodes_of(cells), "nodes")
    pairs = stdbscan._point_pairs(cells, nodes, near, hood)
    for df in (stdbscan.adjacent_boxes(cells, hood.grid), pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "BroadcastHashJoin" not in plan
    # Every place meets its own days and those around, whichever span they are in.
    assert pairs.where("a_box = b_box AND a_day = 15").select("b_day").distinct().count() == 5
