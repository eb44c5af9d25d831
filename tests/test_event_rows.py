"""Event rows are cleaned once."""

from matchloom.operators import harmonise


def test_events_are_cleaned_once(spark):
    rows = [(f"{i % 5}.0", str(i * 7 % 11) if i % 3 else None, "2024-04-01 10:00:00", "A", "nan" if i == 4 else "B") for i in range(20)]
    df = spark.createDataFrame(rows, "GamePk string, SeqNo string, Date string, HomeTeam string, visitor string")
    out = harmonise.normalise_events(df)
    assert "to_timestamp" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["game_id"], r["row_order"]) for r in out.collect())
    assert got == sorted((str(g), n) for g in range(5) for n in range(3 if g == 4 else 4))
