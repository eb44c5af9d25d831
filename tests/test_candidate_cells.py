"""Score candidates are compared without decimal numbers."""

from matchloom.operators import scorelines


def test_candidates_make_no_decimals(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0)], "id long, lambda_home double, lambda_away double")
    plan = scorelines.score_candidates(df, mode="cells_21")._jdf.queryExecution().optimizedPlan().toString()
    assert " round(" not in plan and "-round(" not in plan and "array_sort" not in plan
