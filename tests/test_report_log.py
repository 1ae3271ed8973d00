import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from herdlens.session import new_path
from herdlens.sources import report_log
from herdlens.sources.report_log import LogConflict, ReportLog


@pytest.fixture
def log(spark):
    return ReportLog(spark, new_path(spark, "log"))


def _scored(make_reports, days, risk="HIGH"):
    rows = make_reports([{"date": date(2026, 2, d), "village": f"V{d}"} for d in days])
    return rows.withColumns({"final_risk": F.lit(risk), "arrival": F.col("report_id")})


def _ids(log):
    return [(r.report_id, r.village, r.risk_level) for r in log.read().orderBy("report_id").collect()]


def test_an_empty_log(log):
    assert log.read().count() == 0 and log.appends() == []


def test_appends_take_the_next_ids(log, make_reports):
    log.load(make_reports([{"report_id": 41, "village": "A"}]))
    assert (log.append(_scored(make_reports, [3, 2]), "b1", ["date", "arrival"]).first_id, log.appends()[-1].last_id) == (42, 43)
    log.append(_scored(make_reports, []), "none", ["date", "arrival"])
    log.append(_scored(make_reports, [1], "LOW"), "b2", ["date", "arrival"])
    assert _ids(log) == [(41, "A", "LOW"), (42, "V2", "HIGH"), (43, "V3", "HIGH"), (44, "V1", "LOW")]
    assert [(a.key, a.n_rows, a.last_id) for a in log.appends()] == [("load", 1, 41), ("b1", 2, 43), ("none", 0, 43), ("b2", 1, 44)]


def test_an_append_that_failed_before_its_line_is_repeated_once(log, make_reports, monkeypatch):
    log.load(make_reports([{"report_id": 7}]))

    def broken(number, entry):
        raise OSError("lost before the line was written")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(log, "_commit", broken)
        log.append(_scored(make_reports, [4, 5]), "b1", ["date"])
    assert [r[0] for r in _ids(log)] == [7]  # written, but not counted
    for _ in range(2):
        assert log.append(_scored(make_reports, [4, 5]), "b1", ["date"]).first_id == 8
    assert [r[:2] for r in _ids(log)] == [(7, "A"), (8, "V4"), (9, "V5")]
    assert len(os.listdir(f"{log.folder.removeprefix('file:')}/data/b1")) == 1  # the failed attempt is gone


def test_a_writer_in_between_moves_the_ids(log, make_reports, spark, monkeypatch):
    log.load(make_reports([{"report_id": 7}]))
    other, commit, calls = ReportLog(spark, log.folder), log._commit, []

    def late(number, entry):
        if not calls:
            calls.append(other.append(_scored(make_reports, [9]), "other", ["date"]))
        commit(number, entry)

    monkeypatch.setattr(log, "_commit", late)
    assert log.append(_scored(make_reports, [4, 5]), "mine", ["date"]).first_id == 9
    assert [r[:2] for r in _ids(log)] == [(7, "A"), (8, "V9"), (9, "V4"), (10, "V5")]


def test_a_taken_number_and_bad_keys(log, make_reports, monkeypatch):
    entry = log.load(make_reports([{"report_id": 7}]))
    with pytest.raises(LogConflict):
        log._commit(0, entry)
    assert len(log.appends()) == 1
    for key in ("", "../x", ".hidden", "a b"):
        with pytest.raises(ValueError, match="key"):
            log.append(_scored(make_reports, [1]), key, ["date"])
    monkeypatch.setattr(report_log, "ATTEMPTS", 2)

    def always_late(number, entry):
        raise LogConflict("taken")

    monkeypatch.setattr(log, "_commit", always_late)
    with pytest.raises(LogConflict, match="other writers"):
        log.append(_scored(make_reports, [1]), "b", ["date"])
