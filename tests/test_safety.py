"""Repeated results, moved keys and repeated records."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators import harmonise, joins, reports
from matchloom.plans.durable import fresh_path
from matchloom.sources.store import TableStore, merge_into


def test_merge_moves_keys_between_partitions(spark):
    store = TableStore(spark, fresh_path(spark, "store"))
    frame = lambda rows: spark.createDataFrame(rows, "id long, year int, v int")
    merge_into(store, "raw", "games", frame([(1, 2023, 1), (2, 2023, 1), (3, 2022, 1)]), ["id"], ["v"], "year")
    merge_into(store, "raw", "games", frame([(1, 2024, 2), (3, 2024, 2)]), ["id"], ["v"], "year")
    rows = sorted((r.id, r.year, r.v) for r in store.read("raw", "games").collect())
    assert rows == [(1, 2024, 2), (2, 2023, 1), (3, 2024, 2)]


def test_two_results_do_not_multiply_the_ledger(spark):
    ledger = spark.sql("SELECT 1L AS game_id, timestamp'2024-05-01 03:00:00' AS datetime, 'a' AS home, 'b' AS away, CAST(NULL AS LONG) AS actual, CAST(NULL AS LONG) AS actual_home_score, CAST(NULL AS LONG) AS actual_away_score")
    results = spark.sql("SELECT date'2024-05-01' AS date, 'a' AS home, 'b' AS away, col1 AS home_score, col2 AS away_score FROM VALUES (1L, 5L), (4L, 2L)")
    rows = joins.settle(ledger, results, F.lit("2024-05-03").cast("timestamp")).collect()
    assert [(r.actual, r.actual_home_score, r.actual_away_score) for r in rows] == [(0, 4, 2)]


def test_batting_takes_whole_records(spark):
    rows = spark.createDataFrame([(1, "home", 7, 4, 1), (1, "home", 7, 3, 3), (1, "home", 8, 2, 1)], "game_id long, side string, player_id long, ab long, h long")
    for order in (rows.orderBy("ab"), rows.orderBy(F.desc("ab"))):
        assert [(r.ab, r.h) for r in reports.team_batting(order, ["ab", "h"]).collect()] == [(6, 2)]


def test_season_schedule_repeats_agree(spark):
    raw = spark.createDataFrame([("g", "2024-05-01", "x", "y", s, "2", "regular") for s in ("1", "3")], "game_id string, game_date string, home string, away string, home_score string, away_score string, game_type string")
    for order in (raw, raw.orderBy(F.desc("home_score"))):
        assert [r.home_score for r in harmonise.season_schedule(order, 2024).collect()] == [3]


def test_team_names(spark):
    assert harmonise.TEAM_ALIASES["\u30e4\u30af\u30eb\u30c8"].startswith("\u6771\u4eac")


def contents(store):
    return sorted((tuple(r) for r in store.read("raw", "odd").select("id", "part", "v").collect()), key=repr)


def odd_store(spark):
    store = TableStore(spark, fresh_path(spark, "store"))
    frame = lambda rows: spark.createDataFrame(rows, "id long, part string, v long")
    merge = lambda rows: merge_into(store, "raw", "odd", frame(rows), ["id"], ["v"], "part")
    return store, merge


def test_merge_into_null_and_escaped_partitions(spark):
    """Partition values that are null, empty or hold signs of paths; keys move between them and nothing else is lost."""
    store, merge = odd_store(spark)
    merge([(1, None, 1), (2, "a/b", 1), (3, "x=y%", 1), (4, None, 1), (5, "", 1), (None, "n", 1), (6, "__HIVE_DEFAULT_PARTITION__", 1)])
    merge([(4, None, 2), (1, "x", 2), (2, "x", 2), (None, "m", 2), (5, None, 2)])
    assert contents(store) == sorted([(1, "x", 2), (2, "x", 2), (3, "x=y%", 1), (4, None, 2), (5, None, 2), (None, "m", 2), (6, "__HIVE_DEFAULT_PARTITION__", 1)], key=repr)
    merge([(9, None, 3)])
    assert (4, None, 2) in contents(store) and (9, None, 3) in contents(store) and len(contents(store)) == 8


def test_merge_that_stops_before_the_switch_changes_nothing(spark, monkeypatch):
    store, merge = odd_store(spark)
    merge([(1, "a", 1), (2, "b", 1)])
    before = contents(store)
    with monkeypatch.context() as m:
        m.setattr(TableStore, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            merge([(1, "b", 2), (3, "c", 2)])
    assert contents(store) == before
    merge([(1, "b", 2), (3, "c", 2)])
    assert contents(store) == [(1, "b", 2), (2, "b", 1), (3, "c", 2)]
    # A second writer of the same version fails instead of hiding the first one's rows.
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.switch(store.manifest("raw", "odd").drop("_version"), "raw", "odd", 2)


def test_merge_takes_over_a_plain_table(spark):
    store, merge = odd_store(spark)
    store.write(spark.createDataFrame([(1, "a", 1), (2, None, 1)], "id long, part string, v long"), "raw", "odd", partition=["part"])
    merge([(2, "a", 2)])
    assert contents(store) == [(1, "a", 1), (2, "a", 2)]
    with pytest.raises(ValueError):
        store.write(store.read("raw", "odd"), "raw", "odd")


def test_quarantine_keeps_every_bad_line(spark, tmp_path):
    """Broken, incomplete and stale lines go aside with their file; good ones are read; empty files give nothing."""
    from matchloom.sources import readers

    good = '{"game_id":"g1","prediction_time_utc":"2024-01-01 00:00:00","observations":[{"kind":"STARTER"}]}'
    lines = [good, good.replace("g1", "g2"), '{"game_id":"g3","prediction', '{"prediction_time_utc":"2024-01-01"}', good.replace('"obs', '"schema_version":2,"obs'), "word"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "in" / "b.jsonl").write_text("")
    sink = str(tmp_path / "bad")
    kept = readers.snapshots_or_quarantine(spark, str(tmp_path / "in"), sink)
    assert sorted(r["game_id"] for r in kept.collect()) == ["g1", "g2"]
    bad = spark.read.parquet(sink).collect()
    assert sorted(r["reason"] for r in bad) == ["CORRUPT", "CORRUPT", "INCOMPLETE", "STALE"] and all(r["file"].endswith("a.jsonl") and r["content"] for r in bad)
    # The same files of version 2: only that line is good.
    assert [r["game_id"] for r in readers.snapshots_or_quarantine(spark, str(tmp_path / "in"), sink, 2).collect()] == ["g1"]


def test_rest_state_of_both_sides(spark):
    """Strictly before the game; one side without history is PARTIAL, none UNKNOWN; asymmetry only where both are known."""
    from matchloom.operators import context, form, scorelines

    rows = [(1, "2024-09-20", "A", "B"), (2, "2024-09-23", "A", "C"), (3, "2024-09-25", "A", "B"), (4, "2024-09-25", "D", "E"), (5, "2024-09-27", "A", "B")]
    games = spark.createDataFrame([(i, "L", t + " 18:00:00", h, a, 1, 0, "V1", True) for i, t, h, a in rows], "game_id long, league string, datetime string, home string, away string, home_score long, away_score long, venue string, training_included boolean")
    games = games.withColumn("datetime", F.to_timestamp("datetime"))
    sides = form.team_rows(games).join(games.select("game_id", "venue"), "game_id")
    places = spark.createDataFrame([("V1", 1.0, 2.0)], "venue string, lat double, lon double")
    both = scorelines.rest_travel_games(scorelines.rest_travel(sides, places))
    got = {r["game_id"]: r for r in both.collect()}
    assert {i: r["state"] for i, r in got.items()} == {1: "UNKNOWN", 2: "PARTIAL", 3: "VERIFIED", 4: "UNKNOWN", 5: "VERIFIED"}
    assert got[3]["home"]["rest_days"] == 2 and got[3]["away"]["rest_days"] == 5 and got[3]["home"]["games_3d"] == 1 and got[3]["home"]["games_7d"] == 2
    timed = both.join(games.select("game_id", "datetime"), "game_id").withColumn("event_id", F.col("game_id"))
    events = context.delta_events(scorelines.rest_observations(timed)).collect()
    assert [(r["game_id"], r["event"]) for r in events] == [(3, "REST_ASYMMETRY")]


def test_lineup_without_players_is_neutral(spark):
    from matchloom.operators.joins import LINEUP_NEUTRAL, LINEUP_SUMS, lineup_features

    metrics = ", ".join(f"pp_{m} double" for m in LINEUP_NEUTRAL)
    profiles = spark.createDataFrame([(1, 10, 3.0, 2.0, *[0.5] * 19), (1, 11, 0.0, 0.0, *[0.1] * 19)], f"game_id long, player_id long, pp_pa double, pp_games double, {metrics}")
    lineups = spark.createDataFrame([(1, "home", 10), (1, "home", 11), (1, "home", 12), (2, "away", 99)], "game_id long, side string, player_id long")
    games = spark.createDataFrame([(1, "home"), (1, "away"), (2, "away")], "game_id long, side string")
    got = {(r["game_id"], r["side"]): r for r in lineup_features(lineups, profiles, games).collect()}
    one = got[1, "home"]
    assert one["lineup_avg"] == pytest.approx((0.5 * 3 + 0.1) / 4) and one["lineup_n"] == 3 and one["lineup_known_n"] == 1 and one["lineup_speed_sum"] == pytest.approx(0.6)
    for place, n in (((1, "away"), 0), ((2, "away"), 1)):
        row = got[place]
        assert {m: row[f"lineup_{m}"] for m in LINEUP_NEUTRAL} == LINEUP_NEUTRAL
        assert row["lineup_n"] == n and all(row[f"lineup_{c}"] == 0 for c in (*LINEUP_SUMS, "known_n", "history_coverage"))


def test_promotion_fails_closed(spark):
    from matchloom.operators import context

    metrics = spark.createDataFrame([("a", 300, 1.0, 0.6, 0.5, 0.05), ("b", 300, 0.9, 0.5, 0.6, 0.04)], "v string, rows long, logloss double, brier double, accuracy double, ece double")
    passed = lambda *more: {r["check"]: r["passed"] for r in context.promotion_gate(metrics, "v", "a", "b", *more).collect()}
    bare = passed()
    assert len(bare) == 15 and all(bare[c] for c in ("min_rows", "relative_gain", "logloss", "brier", "accuracy", "ece"))
    assert not any(bare[c] for c in ("high_state", *context.REQUIRED))
    worse = metrics.withColumn("logloss", F.when(F.col("v") == "b", 1.02).otherwise(1.0).cast("double"))
    evidence = spark.createDataFrame([(True, True), (True, None)], "oos boolean, calibration_check boolean")
    full = passed(worse, evidence)
    assert not full["high_state"] and full["oos"] and not full["calibration_check"]
    assert passed(metrics, evidence)["high_state"]
