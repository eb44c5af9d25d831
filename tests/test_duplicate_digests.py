"""Exact duplicates are counted by values."""

from matchloom.operators import reports


def test_duplicates_ship_digests(spark):
    """Zeros of both signs, NaN and nulls repeat as they do in groups; rows of equal digest are told apart by their values."""
    nan = float("nan")
    rows = [(1, 0.0, "x"), (1, -0.0, "x"), (2, nan, None), (2, nan, None), (2, nan, None), (3, None, "a"), (None, 3.0, "a"), (4, 1.0, "b")]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    out = reports.quality_profile(df, ["b"]).first()
    assert (out["rows"], out["duplicates"], out["status"]) == (8, 3, "FAIL")
    distinct = df.filter("a = 4").unionByName(df.filter("c = 'a'"))
    plan = reports.quality_profile(distinct, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and reports.quality_profile(distinct, ["b"]).first()["duplicates"] == 0


def test_values_stay_where_they_are_read(spark):
    """Fences go to the values; no task gets all values of a column."""
    df = spark.range(400).selectExpr("id", "cast(if(id % 5 = 0, id * 1000, id % 7) as double) v")
    out = reports.quality_profile(df, ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [column" not in plan and "BroadcastHashJoin [column" in plan
    assert (out.first()["rows"], out.first()["outlier_columns"]) == (400, 1)
