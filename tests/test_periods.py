from pyspark.sql import functions as F

from colloquy.functions import periods


def labels(spark, values, f):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, q string").orderBy("i").select(f(F.col("q")).alias("x")).collect()]


def test_shared_periods(spark):
    assert labels(spark, ["2025-interim", "2025-q2", "2024-annual", "2024-fy", "2024-q1", "2024-q3", "junk", None], periods.calendar_period) == [
        "2025-H1", "2025-H1", "2024-FY", "2024-FY", "2024-H1q1", "2024-Q3", "junk", None,
    ]


def test_order_window_and_short_form(spark):
    assert labels(spark, ["2014-H1", "2014-annual", "2014-q1", "x"], periods.period_order) == [2, 4, 1, 9]
    assert labels(spark, ["2011-H1", "2012-q1", "2025-fy", "2026-q1", "x"], periods.coverage_window) == ["single_bank", "both_complete", "both_complete", "partial", "unknown"]
    assert labels(spark, ["2014-interim", "2014-q3", "x"], periods.compact_label) == ["14H1", "14Q3", "x"]


def test_dates_are_distinct(spark):
    d = labels(spark, ["2020-q1", "2020-q2", "2020-interim", "2020-q3", "2020-q4", "2020-annual", "junk"], periods.period_date)
    assert len(set(d[:6])) == 6 and d[6] is None
