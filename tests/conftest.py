import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from herdlens.config import SYMPTOM_COLUMNS  # noqa: E402
from herdlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_reports(spark):
    """Full reports from partial rows; ids and harmless values are filled in."""
    from datetime import date

    from herdlens import schema

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "report_id": i + 1, "date": date(2026, 1, 5), "district": "D1", "block": "B1", "village": "A",
                "species": "cattle", "number_affected": 2, "number_deaths": 0, "duration_days": 2,
                "temperature": 38.5, "notes": "", "mortality_rate": 0.0, "risk_level": "LOW",
            } | dict.fromkeys(SYMPTOM_COLUMNS, False)
            base.update(row)
            full.append(tuple(base[f.name] for f in schema.REPORTS.fields))
        return spark.createDataFrame(full, schema.REPORTS)

    return build
