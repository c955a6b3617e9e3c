"""Parsing of filings on cases worked by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import filings as f


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("label, want", [
    ("$1,001 - $15,000", (1001, 15000, 8000.5)), ("$1,001 -", (1001, 15000, 8000.5)), ("$7,500", (1001, 15000, 8000.5)), ("Over $50,000,000", (50e6, 100e6, 75e6)), ("$500", (500, 500, 500)), ("--", (None,) * 3), (None, (None,) * 3),
])
def test_amounts(spark, label, want):
    assert tuple(one(spark, f.amount_range(F.col("x")), x=label)) == want


@pytest.mark.parametrize("label, want", [("3/4/2021", (2021, 3, 4)), ("2021-03-04", (2021, 3, 4)), ("03/04/99", (1999, 3, 4)), ("03/04/05", (2005, 3, 4)), ("13/40/2021", None), ("N/A", None), (None, None)])
def test_dates(spark, label, want):
    assert one(spark, f.reported_date(F.col("x")), x=label) == (datetime.date(*want) if want else None)


@pytest.mark.parametrize("text, want", [("Q2 2024", "Q2-2024"), ("the third quarter, then Q4", "Q3-UNKNOWN"), ("fiscal year 2023 and Q1", "FY2023"), ("soon", "PERIOD-UNKNOWN"), ("by 2030", "PERIOD-2030")])
def test_periods(spark, text, want):
    assert one(spark, f.guidance_period(F.col("x")), x=text) == want


@pytest.mark.parametrize("a, b, want", [(100.0, 100.9, True), (100.0, 102.0, False), (0.0, 0.0009, True), (0.0, 0.002, False), (-5.0, 5.0, False)])
def test_close_enough(spark, a, b, want):
    assert one(spark, f.close_enough(F.col("a"), F.col("b")), a=a, b=b) is want
    assert one(spark, f.close_enough(F.col("a"), F.lit(None).cast("double")), a=a, b=b) is False


def test_offsets_are_needed(spark):
    assert one(spark, f.utc_instant(F.col("x")), x="2024-03-01T10:00:00") is None
    assert one(spark, F.date_format(f.acceptance_time(F.col("x")), "HH:mm"), x="2024-03-01T10:00:00") == "15:00"
    assert one(spark, F.date_format(f.acceptance_time(F.col("x")), "HH:mm"), x="2024-03-01T10:00:00+02:00") == "08:00"
