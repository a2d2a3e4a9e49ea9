"""Gaps: rows of one time."""

from ridgeline.operators import series


def test_the_first_row_of_a_time_has_the_gap(spark):
    rows = [(1, 0, 10), (1, 9, 100), (1, 7, 100), (1, 8, 100)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, t int").coalesce(1)
    assert [(r.event_id, r.gap) for r in series.gaps(df, ["user_id"], "t", 50, ("event_id",)).collect()] == [(7, 90)]
