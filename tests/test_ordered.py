"""Sliced execution of hot groups gives the rows of the plain windows, and both match plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from matchloom.operators import drift, form, joins, reports
from matchloom.plans import ordered
from matchloom.plans.ordered import GROUP_LIMIT_CONF, Timeline


def both_ways(spark, build, keys):
    plain = rows_of(build(), keys)
    spark.conf.set(GROUP_LIMIT_CONF, "7")
    try:
        sliced = rows_of(build(), keys)
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)
    pd.testing.assert_frame_equal(plain, sliced, check_dtype=False, atol=1e-9, rtol=1e-9)
    return plain


KEYS = ["game_id", "team"]


@pytest.mark.parametrize(
    "op",
    [
        lambda r: form.rolling_form(r, (3, 10)), form.rest_days, form.games_last_days, form.bullpen_decay, form.same_opponent,
        form.shrunk_win_rate, form.venue_split, form.volatility, lambda r: form.rolling_form(r, (2, 25)),
    ],
)
def test_team_features_sliced(spark, games, op):
    both_ways(spark, lambda: op(form.team_rows(games)), KEYS)


def test_game_features_sliced(spark, games):
    both_ways(spark, lambda: form.venue_environment(games), ["game_id"])
    both_ways(spark, lambda: form.head_to_head(games), ["game_id"])
    both_ways(spark, lambda: form.context_readiness(games, F.col("game_id") % 5 != 0, F.col("game_id") % 3 != 0), ["game_id"])
    both_ways(spark, lambda: Timeline(games, ["league"], ["datetime", "game_id"]).positions(), ["game_id"])
    both_ways(spark, lambda: Timeline(games, [], ["datetime", "game_id"]).positions(), ["game_id"])
    both_ways(spark, lambda: drift.recency_weights(games), ["game_id"])


def test_drift_sliced(spark, games):
    k = F.col("game_id")
    e = games.withColumns(
        {
            "e0": F.array((k % 7 + 1) / 20.0, (k % 5 + 1) / 20.0, F.lit(1.0) - (k % 7 + 1) / 20.0 - (k % 5 + 1) / 20.0), "e1": F.array(F.lit(0.5), (k % 3) / 10.0, F.lit(0.5) - (k % 3) / 10.0),
            "actual": k % 3, "f0": (k % 11).cast("double"), "f1": (k * 3 % 7).cast("double"),
        }
    )
    both_ways(spark, lambda: drift.output_drift(e, ["e0", "e1"]).select("game_id", "output_drift"), ["game_id"])
    both_ways(spark, lambda: drift.feature_drift(e, ["f0", "f1"]).select("game_id", "feature_drift"), ["game_id"])
    both_ways(spark, lambda: drift.mmd_drift(e, ["f0", "f1"]).select("game_id", "mmd_drift"), ["game_id"])
    both_ways(spark, lambda: drift.expert_losses(e, ["e0", "e1"]).drop("e0", "e1"), ["game_id"])
    both_ways(spark, lambda: drift.conformal(e, "e0").select("game_id", "set_size", "conformal_signal"), ["game_id"])


def test_order_statistics_and_ranks(spark, games):
    exact = {"q25": lambda n: (n - 1) * F.lit(0.25), "mid": lambda n: (n - 1) / 2.0, "near": lambda n: F.floor(3 * n / 4)}
    got = both_ways(spark, lambda: ordered.values_at_ranks(games, ["league"], "home_score", exact), ["league"])
    for league, part in games.toPandas().groupby("league"):
        v = np.sort(part.home_score.to_numpy(float))
        row = got[got.league == league].iloc[0]
        assert row.q25 == pytest.approx(np.quantile(v, 0.25)) and row.mid == pytest.approx(np.median(v)) and row.near == v[3 * len(v) // 4]
    scored = games.withColumn("p", (F.col("game_id") * 37 % 23) / 23.0)
    both_ways(spark, lambda: reports.auc(scored, "p", F.col("home_score") > F.col("away_score"), ["league"]), ["league"])


def test_counts_within_matches_loop(spark, games):
    us = games.withColumn("us", F.unix_micros("datetime"))
    got = both_ways(spark, lambda: ordered.counts_within(us, ["league"], "us", {"n": 5 * form.DAY_US}).select("game_id", "league", "us", "n"), ["game_id"])
    for r in got.itertuples():
        want = ((got.league == r.league) & (got.us < r.us) & (got.us >= r.us - 5 * form.DAY_US)).sum()
        assert r.n == want


def test_as_of_sliced(spark, games):
    left = games.filter("game_id % 2 = 0").select("game_id", "league", F.col("datetime").alias("cut"))
    right = games.filter("game_id % 3 = 0").select("league", F.col("datetime").alias("at"), F.col("game_id").alias("snap"))
    got = both_ways(spark, lambda: joins.as_of(left, right, ["league"], "cut", "at", ["snap"], "snap").select("game_id", "league", "cut", "matched_at", "snap"), ["game_id"])
    r = right.toPandas()
    for row in got.itertuples():
        past = r[(r.league == row.league) & (r["at"] <= row.cut)]
        assert (pd.isna(row.matched_at) and past.empty) or row.matched_at == past["at"].max()


def test_decayed_profiles_match_loop(spark, games, small_groups):
    lines = games.selectExpr("league", "game_id", "datetime", "home as pitcher", "cast(home_score as double) era", "training_included as eligible")
    lines = lines.withColumn("era", F.when(F.col("game_id") % 5 != 0, F.col("era")))
    got = form.starter_profiles(lines).toPandas().set_index("game_id")
    hist = {}
    for r in lines.toPandas().sort_values(["datetime", "game_id"]).itertuples():
        past = hist.setdefault((r.league, r.pitcher), [])
        v = np.array([x for x in past], float)
        ok = np.isfinite(v)
        w = np.exp(-(len(v) - 1 - np.arange(len(v))) / 18.0)
        want = np.average(v[ok], weights=w[ok]) if ok.any() else 4.0
        assert got.loc[r.game_id, "sp_era"] == pytest.approx(want, abs=1e-9)
        five = v[-5:][np.isfinite(v[-5:])]
        assert got.loc[r.game_id, "sp_recent_era"] == pytest.approx(five.mean() if len(five) else 4.0)
        tail = v[ok][-8:]
        slope = np.polyfit(np.arange(len(tail)), tail, 1)[0] if len(v) >= 3 and len(tail) >= 3 else 0.0
        assert got.loc[r.game_id, "sp_era_slope"] == pytest.approx(slope, abs=1e-8)
        if r.eligible:
            past.append(r.era if r.era is not None else np.nan)


def test_features_see_only_the_past(spark, games):
    """Changing rows at or after a game never changes earlier feature rows."""
    cut = games.orderBy("datetime", "game_id").limit(90).agg(F.max(F.struct("datetime", "game_id")).alias("m")).first()["m"]
    at = F.lit(cut["datetime"])
    later = (F.col("datetime") > at) | ((F.col("datetime") == at) & (F.col("game_id") >= cut["game_id"]))
    changed = games.withColumn("home_score", F.when(later, F.col("home_score") + 5).otherwise(F.col("home_score")))
    early = ~later

    def features(g):
        df = form.rest_days(form.rolling_form(form.team_rows(g), (5, 20)))
        df = form.bullpen_decay(form.games_last_days(df)).drop("gf", "ga")
        return rows_of(df.filter(early), KEYS)

    pd.testing.assert_frame_equal(features(games), features(changed))


@pytest.mark.parametrize("sliced", [False, True])
def test_rolling_survives_nan_infinity_and_huge_values(spark, request, sliced):
    if sliced:
        request.getfixturevalue("small_groups")
    odd = {5: float("nan"), 20: float("inf"), 35: 1e17}
    rows = [("k", i, odd.get(i, 1.0), 2**62 if i == 10 else i, i % 4 != 1) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, pos long, x double, n long, live boolean")
    for eligible in (None, "live"):
        got = ordered.Timeline(df, ["key"], ["pos"], eligible=eligible).rolling({"x": F.col("x"), "m": F.col("n")}, [3, 7]).toPandas().set_index("pos")
        past = []
        for key, pos, x, n, live in rows:
            for w in (3, 7):
                tail = past[-w:]
                assert got.loc[pos, f"x_{w}"] == pytest.approx(sum(v for v, _ in tail), nan_ok=True)
                assert got.loc[pos, f"n_{w}"] == len(tail) and got.loc[pos, f"m_{w}"] == float(sum(m for _, m in tail))
            if live or eligible is None:
                past.append((x, n))


@pytest.mark.parametrize("sliced", [False, True])
def test_decayed_mean_is_kept_over_long_gaps(spark, request, sliced):
    if sliced:
        request.getfixturevalue("small_groups")
    value = {0: 5.0, 3: 2.0, 4: float("nan"), 150: 9.0}
    df = spark.createDataFrame([("k", i, value.get(i)) for i in range(170)], "key string, pos long, x double")
    for eligible in (None, "live"):
        line = ordered.Timeline(df.withColumn("live", F.lit(True)), ["key"], ["pos"], eligible=eligible)
        got = line.decayed({"m": F.col("x")}, 1.0).toPandas().set_index("pos").m
        early = (5.0 * math.exp(-3.0) + 2.0) / (math.exp(-3.0) + 1.0)
        assert np.isnan(got[0]) and got[2] == 5.0
        assert got[4] == pytest.approx(early) and got[149] == pytest.approx(early) and got[150] == pytest.approx(early)
        assert got[151] == pytest.approx(9.0) and got[169] == pytest.approx(9.0)
