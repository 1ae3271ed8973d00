"""Declared schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

from herdlens.config import SYMPTOM_COLUMNS

REPORTS = T.StructType(
    [
        T.StructField("report_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("district", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("village", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("number_affected", T.IntegerType()),
        T.StructField("number_deaths", T.IntegerType()),
        T.StructField("duration_days", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("notes", T.StringType()),
        *[T.StructField(c, T.BooleanType()) for c in SYMPTOM_COLUMNS],
        T.StructField("mortality_rate", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
    ]
)

# What a sender fills in; everything else is computed.
INCOMING = T.StructType(
    [f for f in REPORTS.fields if f.name not in ("report_id", "mortality_rate", "risk_level")]
)

REGIONS = T.StructType(
    [
        T.StructField("district", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("village", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)
