import random

import numpy as np

from herdlens.functions.numeric import fixed_text, percent_text, round_exact, round_scaled
from pyspark.sql import functions as F


def _values():
    rnd = random.Random(5)
    ratios = [a / b for b in (3, 7, 16, 32, 64, 160, 320, 640, 1600) for a in range(0, 40)]
    ties = [0.00625, 0.03125, 0.0625, 2.675, 1.005, 0.125, 0.375, 41.25, 12.5, 0.5, 1.5, 2.5, 0.0005, 8.345]
    return ratios + ties + [rnd.uniform(0, 100) for _ in range(300)]


def test_round_exact_equals_python_rounding(spark):
    values = _values()
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for digits in (0, 1, 2, 3, 4):
        got = [r[0] for r in df.select(round_exact("x", digits)).collect()]
        assert got == [float(round(v, digits)) for v in values], digits


def test_round_scaled_equals_array_rounding(spark):
    values = _values()
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(round_scaled(F.col("x"), 3)).collect()]
    assert got == np.round(np.array(values), 3).tolist()


def test_number_texts_equal_python_formats(spark):
    values = [v for v in _values() if v < 20]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = df.select(percent_text("x"), percent_text("x", 1), fixed_text("x", 2)).collect()
    assert [r[0] for r in rows] == [f"{v:.0%}" for v in values]
    assert [r[2] for r in rows] == [f"{v:.2f}" for v in values]
