"""Lineups meet the profiles of their game in the shuffle that adds them up."""

import pytest

from matchloom.operators.joins import LINEUP_NEUTRAL, lineup_features


def _tables(spark):
    # Player 2 has two profiles in game 1 and is named twice there; null players and games find nothing.
    lineups = [(g, s, p) for g in range(6) for s in ("home", "away") for p in range(g, g + 4)] + [(1, "home", 2), (2, "home", None), (None, "home", 3)]
    profiles = [(g, p, float(1 + (g + p) % 4), float(p % 3), *[(g + p + i) / 50.0 for i in range(len(LINEUP_NEUTRAL))]) for g in range(5) for p in range(0, 9, 2)]
    profiles += [(1, 2, 9.0, 1.0, *[0.5] * len(LINEUP_NEUTRAL)), (None, 3, 9.0, 1.0, *[0.5] * len(LINEUP_NEUTRAL))]
    columns = ", ".join(f"pp_{m} double" for m in LINEUP_NEUTRAL)
    return lineups, profiles, spark.createDataFrame(lineups, "game_id long, side string, player_id long"), spark.createDataFrame(profiles, f"game_id long, player_id long, pp_pa double, pp_games double, {columns}")


def test_lineups_are_dealt_once(spark):
    *_, lineups, profiles = _tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lineup_features(lineups, profiles)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning" in line for line in plan) == 2


def test_lineups_match_a_plain_loop(spark):
    rows, known, lineups, profiles = _tables(spark)
    got = {(r["game_id"], r["side"]): r for r in lineup_features(lineups, profiles).collect()}
    for key in {(g, s) for g, s, _ in rows}:
        met = []
        for g, s, p in rows:
            if (g, s) == key:
                met += [k for k in known if None not in (g, p) and k[:2] == (g, p)] or [None]
        found = [k for k in met if k]
        weight = sum(max(k[2], 1.0) for k in found)
        want = sum(k[4] * max(k[2], 1.0) for k in found) / weight if found else LINEUP_NEUTRAL["avg"]
        row = got.pop(key)
        assert row["lineup_avg"] == pytest.approx(want) and row["lineup_n"] == len(met) and row["lineup_known_n"] == sum(k[3] > 0 for k in found)
    assert not got
