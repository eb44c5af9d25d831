"""Sequential recursions: sliced parallel passes end with the plain loop's result."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from matchloom.operators import drift, rating, routing
from matchloom.plans.ordered import GROUP_LIMIT_CONF


def loop_elo(pdf, keep=0.20):
    out, r, season = {}, {}, {}
    for g in pdf.sort_values(["datetime", "game_id"]).itertuples():
        y = g.datetime.year
        if season.get(g.league) not in (None, y):
            for k in [k for k in r if k[0] == g.league]:
                r[k] = 1500 + keep * (r[k] - 1500)
        season[g.league] = y
        h, a = r.get((g.league, g.home), 1500.0), r.get((g.league, g.away), 1500.0)
        e = 1 / (1 + 10 ** (-(h + 25 - a) / 400))
        out[g.game_id] = (h, a, e)
        if g.training_included:
            won = 1.0 if g.home_score > g.away_score else 0.5 if g.home_score == g.away_score else 0.0
            k = 20 * (1 + 0.35 * math.log1p(abs(g.home_score - g.away_score))) * (won - e)
            r[(g.league, g.home)], r[(g.league, g.away)] = h + k, a - k
    return out


@pytest.mark.parametrize("limit", ["1000000", "30"])
def test_elo_equals_loop(spark, games, limit):
    spark.conf.set(GROUP_LIMIT_CONF, limit)
    try:
        got = rating.ratings(games).toPandas().set_index("game_id")
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)
    for gid, want in loop_elo(games.toPandas()).items():
        assert tuple(got.loc[gid, ["elo_home", "elo_away", "elo_expected"]]) == pytest.approx(want, abs=1e-6)


def seasons_of_teams(spark, per_season=60, seasons=8, stay=0):
    """Every season has its own teams, but for ``stay`` that play on."""
    import random

    rng, out = random.Random(4), []
    for y in range(seasons):
        teams = [f"all{k}" for k in range(stay)] + [f"s{y}t{k}" for k in range(6 - stay)]
        for g in range(per_season):
            h, a = rng.sample(teams, 2)
            out.append(("L", y * per_season + g, f"{2000 + y + y // 3}-0{1 + g * 9 // per_season}-01 00:00:00", h, a, rng.randrange(6), rng.randrange(6), rng.random() < 0.8))
    df = spark.createDataFrame(out, "league string, game_id long, datetime string, home string, away string, home_score long, away_score long, training_included boolean")
    return df.withColumn("datetime", F.to_timestamp("datetime"))


@pytest.mark.parametrize("stay", [0, 1, 6])
def test_runs_per_slice_are_bounded(spark, stay):
    """Teams that stop hand nothing on: two runs a slice at most; with teams that play on for ever, three."""
    games = seasons_of_teams(spark, stay=stay).cache()
    spark.conf.set(GROUP_LIMIT_CONF, "30")
    try:
        log = []
        got = rating.ratings(games, log=log).toPandas().set_index("game_id")
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)
    for gid, want in loop_elo(games.toPandas()).items():
        assert tuple(got.loc[gid, ["elo_home", "elo_away", "elo_expected"]]) == pytest.approx(want, abs=1e-6)
    assert log[0] >= 12 and sum(log) <= (2 if stay == 0 else 3) * log[0], log


def test_draw_model_uses_no_result(spark, games):
    got = rating.ratings(games, "three_way").toPandas()
    assert np.allclose(got.p_home + got.p_draw + got.p_away, 1.0) and (got.p_draw <= 0.28).all()


def experts(games):
    k = F.col("game_id")
    v = lambda m, b: F.array((k % m + b) / 60.0, F.lit(0.2), F.lit(0.8) - (k % m + b) / 60.0)
    return games.withColumns({"e0": v(17, 8), "e1": v(11, 14), "e2": v(23, 5), "actual": F.when(k % 5 < 2, 0).when(k % 5 == 2, 1).otherwise(2)})


def test_routing_sliced_equals_whole(spark, games):
    e = experts(games)
    run = lambda: rows_of(routing.replay(e, ["e0", "e1", "e2"]).select("game_id", F.element_at("routed", 1).alias("r"), F.element_at("weights", 1).alias("w"), "temperature", "drift"), ["game_id"])
    whole = run()
    spark.conf.set(GROUP_LIMIT_CONF, "40")
    try:
        sliced = run()
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)
    pd.testing.assert_frame_equal(whole, sliced, atol=1e-8)
    assert whole.w.between(0.029, 1.0).all()


def test_routing_weights_sum_and_floor():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), size=4)
    w, doubt, _ = routing.route(p, rng.random((40, 4)), 0.5, None, 0.2, routing.Routing())
    assert w.sum() == pytest.approx(1.0) and w.min() > 0.02 and 0 <= doubt <= 1


def test_grid_refit_equals_direct_search():
    rng = np.random.default_rng(1)
    cfg = routing.Routing()
    t = routing.Temperature(cfg)
    ps, ys = rng.dirichlet(np.ones(3) * 2, size=80), rng.integers(0, 3, 80)
    for p, y in zip(ps, ys):
        t.resolve(p, y)
    direct = routing.Temperature(cfg)
    for i in range(1, 81):
        p, y = ps[:i][-96:], ys[:i][-96:]
        n = len(y)
        if n < 60:
            continue
        check = max(15, int(round(n * 0.3)))
        nll = lambda q, yy: float(np.mean(-np.log(q[np.arange(len(yy)), yy])))
        losses = [nll(routing.tempered(p[: n - check], g), y[: n - check]) + 0.01 * (g - 1) ** 2 for g in direct.grid]
        cand = direct.grid[int(np.argmin(losses))]
        if nll(routing.tempered(p[n - check:], cand), y[n - check:]) + 0.0005 < nll(routing.tempered(p[n - check:], direct.t), y[n - check:]):
            direct.t = min(max(direct.t + 0.15 * min(max(cand - direct.t, -0.15), 0.15), 0.65), 1.9)
    assert t.t == pytest.approx(direct.t, abs=1e-12)


def test_mmd_matches_pairwise_loop():
    rng = np.random.default_rng(2)
    past, now = rng.random((3, 12, 4)), rng.random((3, 4))
    got = drift.mmd_scores(past, now)
    for b in range(3):
        mu, sd = past[b].mean(0), past[b].std(0, ddof=1)
        x, z = (past[b] - mu) / sd, ((now[b] - mu) / sd)[None]
        pool = np.vstack([x, z])
        d = [float(((i - j) ** 2).sum()) for i in pool for j in pool]
        g = 1 / (2 * np.median([v for v in d if v > 0]))
        k = lambda u, v: np.mean([[math.exp(-g * ((i - j) ** 2).sum()) for j in v] for i in u])
        assert got[b] == pytest.approx(1 - math.exp(-max(k(x, x) + k(z, z) - 2 * k(x, z), 0)), abs=1e-10)
