"""Score candidates, Low/High probabilities, match-up signals and the structural run prior."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import dist, prob
from matchloom.plans.ordered import Timeline

# mode -> (largest score per side, OTHER event, renormalised)
CANDIDATE_MODES = {"with_other": (6, True, False), "cells_7": (6, False, False), "cells_13": (12, False, True), "cells_21": (20, False, True)}
OTHER = 999  # both sides of the OTHER event


def _label(c: Column) -> Column:
    return F.when(c["h"] == OTHER, "OTHER").otherwise(F.concat_ws("-", c["h"].cast("string"), c["a"].cast("string")))


def _places(p: Column, n: int) -> Column:
    """``p`` in whole units of the n-th place, to compare by: ``round`` would make a decimal number of every cell."""
    return F.rint(p * F.lit(10.0**n))


def _best(cells: Column, n: int) -> Column:
    """The n likeliest of array<struct(h, a, p)>; ties by (h, a), OTHER last.

    Probabilities are compared after rounding to 12 places so that algebraic ties stay ties.
    """
    keyed = F.transform(cells, lambda c: F.struct((-_places(c["p"], 12)).alias("k"), c["h"].alias("h"), c["a"].alias("a"), c["p"].alias("p")))
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda c: F.struct(_label(c).alias("label"), c["p"].alias("p")))


def _cell(h: Column, a: Column, p: Column) -> Column:
    return F.struct(h.cast("int").alias("h"), a.cast("int").alias("a"), p.alias("p"))


def score_candidates(df: DataFrame, home: str = "lambda_home", away: str = "lambda_away", n: int = 4, mode: str = "with_other") -> DataFrame:
    """Adds ``candidates``: the n likeliest scorelines of each game, computed inside the row (no shuffle).

    A cell that is r-th best for home and s-th best for away has r * s - 1 cells at least as likely, so only
    pairs with r * s <= n can be among the n best; the full grid is never built.
    """
    top, other, renorm = CANDIDATE_MODES[mode]

    def side(masses: str) -> Column:
        cells = F.transform(masses, lambda p, i: F.struct((-_places(p, 14)).alias("k"), i.alias("i"), p.alias("p")))
        return F.slice(F.sort_array(cells), 1, n)

    df = df.withColumns({"_hp": dist.poisson_array(F.col(home), top), "_ap": dist.poisson_array(F.col(away), top)})
    df = df.withColumns({"_h": side("_hp"), "_a": side("_ap"), "_z": prob.total(F.col("_hp")) * prob.total(F.col("_ap"))})
    scale = F.col("_z") if renorm else F.lit(1.0)
    cells = [
        _cell(F.col("_h")[r]["i"], F.col("_a")[s]["i"], F.col("_h")[r]["p"] * F.col("_a")[s]["p"] / scale)
        for r in range(n) for s in range(n) if (r + 1) * (s + 1) <= n
    ]
    if other:
        cells.append(_cell(F.lit(OTHER), F.lit(OTHER), F.greatest(F.lit(1.0) - F.col("_z"), F.lit(0.0))))
    return df.withColumn("candidates", _best(F.array(*cells), n)).drop("_h", "_a", "_z", "_hp", "_ap")


def _bivariate_cells(top: int, n: int):
    """Cells of a batch of games and the n likeliest of them, in the order of ``_best``."""
    sides = [(h, a) for h in range(top + 1) for a in range(top + 1)] + [(OTHER, OTHER)]
    labels = [f"{h}-{a}" for h, a in sides[:-1]] + ["OTHER"]
    counts, logs = np.arange(top + 1.0), np.array([math.lgamma(k + 1.0) for k in range(top + 1)])

    def masses(lam: pa.Array) -> np.ndarray:
        rate = np.maximum(lam.to_numpy(zero_copy_only=False), 1e-300)[:, None]
        return np.exp(-rate + counts * np.log(rate) - logs)

    def lists(values: pa.Array, rows: int, width: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width), pa.int32()), values)

    def run(home: pa.Array, away: pa.Array, shared: pa.Array) -> pa.Array:
        x, y, w = masses(home)[:, :, None], masses(away)[:, None, :], masses(shared)[:, :, None, None]
        rows, joint = len(home), x * y * w[:, 0]
        for k in range(1, top + 1):
            joint[:, k:, k:] += x[:, : top + 1 - k] * y[:, :, : top + 1 - k] * w[:, k]
        joint = joint.reshape(rows, -1)
        mass = np.cumsum(joint, axis=1)[:, -1:]
        rest = np.maximum(1.0 - mass, 0.0)
        p = np.concatenate([joint, rest], axis=1) / (mass + rest)
        best = np.argsort(-np.rint(p * 1e12), axis=1, kind="stable")[:, :n]
        grid = np.tile(np.array(sides, np.int32), (rows, 1))
        cells = pa.StructArray.from_arrays([pa.array(grid[:, 0]), pa.array(grid[:, 1]), pa.array(p.ravel())], names=["h", "a", "p"])
        named = pa.array(labels).take(pa.array(best.ravel()))
        some = pa.StructArray.from_arrays([named, pa.array(np.take_along_axis(p, best, axis=1).ravel())], names=["label", "p"])
        return pa.StructArray.from_arrays([lists(cells, rows, len(sides)), lists(some, rows, best.shape[1])], names=["space", "candidates"])

    return run


def bivariate_candidates(df: DataFrame, shared: Column, home: str = "lambda_home", away: str = "lambda_away", n: int = 4, top: int = 6) -> DataFrame:
    """Adds ``space`` (0-6 cells and OTHER, mass one) and ``candidates`` of h = X + Z, a = Y + Z; batches of games share the loops over cells."""
    mh, ma = F.greatest(F.col(home), F.lit(1e-9)), F.greatest(F.col(away), F.lit(1e-9))
    df = df.withColumn("_s", F.least(F.greatest(shared, F.lit(0.0)), mh, ma))
    cells = F.arrow_udf(_bivariate_cells(top, n), "struct<space:array<struct<h:int,a:int,p:double>>,candidates:array<struct<label:string,p:double>>>")
    df = df.withColumn("_cells", cells((mh - F.col("_s")).cast("double"), (ma - F.col("_s")).cast("double"), F.col("_s").cast("double")))
    return df.withColumns({"space": F.col("_cells.space"), "candidates": F.col("_cells.candidates")}).drop("_s", "_cells")


def categorical_nll(space: Column, home: Column, away: Column) -> Column:
    """-ln of the observed cell (any side above six is OTHER)."""
    big = (home >= 7) | (away >= 7)
    seen = F.struct(F.when(big, OTHER).otherwise(home).alias("h"), F.when(big, OTHER).otherwise(away).alias("a"))
    hit = prob.let(seen, lambda at: F.filter(space, lambda c: (c["h"] == at["h"]) & (c["a"] == at["a"])))
    return -F.ln(F.greatest(F.coalesce(F.try_element_at(hit, F.lit(1))["p"], F.lit(1e-12)), F.lit(1e-12)))


def low_high(home: Column, away: Column, mode: str = "total", home_size: Column | None = None, away_size: Column | None = None) -> Column:
    """P(Low): total <= 6 (``total``), truncated at 30 (``truncated``), both sides <= 6 (``both``, optionally NB)."""
    if mode == "total":
        return dist.low_total(home, away)
    if mode == "truncated":
        return dist.low_total_truncated(home, away)
    if mode == "both":
        if home_size is None or away_size is None:
            return dist.low_both_sides(home, away)
        return F.least(dist.nb_cdf(home, home_size) * dist.nb_cdf(away, away_size), F.lit(1.0))
    raise ValueError(f"unknown Low/High mode: {mode}")


def candidate_contract(candidates: DataFrame, n: int = 4) -> DataFrame:
    """Violations and the kept ranks of delivered candidates (event_id, score, probability).

    Repeated labels are counted per (event, label) first; the rank uses the bounded timeline.
    """
    p = F.col("probability")
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1) | (F.trim(F.coalesce("score", F.lit(""))) == "")
    labels = candidates.groupBy("event_id", F.trim("score").alias("score")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("probability").alias("probability"), F.count_if(bad).alias("_bad")
    )
    keyed = labels.withColumn("_neg", -F.col("probability"))
    ranked = Timeline(keyed, ["event_id"], ["_neg", "score"]).positions("rank")
    checks = labels.groupBy("event_id").agg(F.sum("_bad").alias("bad_values"), F.count_if(F.col("_n") > 1).alias("repeated_labels"))
    return ranked.filter(F.col("rank") <= n).select("event_id", "rank", "score", "probability").join(checks, "event_id")


def top_players(players: DataFrame, n: int = 3) -> DataFrame:
    """Player-of-the-match candidates per match; matches without scored players are ``insufficient_data``."""
    scored = players.filter("score_proxy is not null").withColumn("_neg", -F.col("score_proxy"))
    ranked = Timeline(scored, ["match_id"], ["_neg", "player_id"]).positions("rank").filter(F.col("rank") <= n).drop("_neg")
    matches = players.select("match_id").distinct()
    out = matches.join(ranked.select("match_id", "rank", "player_id", F.round(F.col("prob") * 100, 2).alias("probability_pct")), "match_id", "left")
    return out.withColumn("status", F.when(F.col("rank").isNull(), "insufficient_data").otherwise("ok"))


def inverse_loss_weights(losses: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k best models per key with weights proportional to 1 / loss; model lists are short by nature."""
    best = losses.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("loss", "model"))).filter(F.col("rank") <= k)
    inv = F.lit(1.0) / F.greatest("loss", F.lit(1e-6))
    return best.withColumn("weight", inv / F.sum(inv).over(Window.partitionBy(*keys))).withColumn("rank", F.col("rank").cast("long"))


# ---- match-up features -------------------------------------------------------------------------


def _c(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(float(default))


def matchup_features(df: DataFrame) -> DataFrame:
    """Interactions of home (h_), away (a_), starter (hs_ / as_) and weather columns; absent ones are neutral."""
    x = lambda n, v=0.0: _c(df, n, v)
    both = lambda n, v=0.0: (x(f"h_{n}", v), x(f"a_{n}", v))
    diff = lambda n, v=0.0: x(f"h_{n}", v) - x(f"a_{n}", v)
    env = 0.5 * (x("h_gf_10") + x("a_gf_10") + x("h_ga_10") + x("a_ga_10"))
    quality = lambda s: x(f"{s}_k9", 7.5) - x(f"{s}_bb9", 3.0) - x(f"{s}_hr9", 1.0)
    kbb = lambda s: x(f"{s}_k9", 7.5) - x(f"{s}_bb9", 3.0)
    tired = lambda s: x(f"{s}_bp_app_10") * F.greatest(F.lit(2.0) - x(f"{s}_rest_days", 30.0), F.lit(0.0))
    contact = lambda s: x(f"{s}_bat_avg_10") - x(f"{s}_bat_so_rate_10")
    out = {
        "expected_env": F.greatest(F.least(env, F.lit(12.0)), F.lit(0.5)),
        "bat_vs_fip_home": x("h_bat_avg_10") - x("as_fip", 4.0) / 20,
        "bat_vs_fip_away": x("a_bat_avg_10") - x("hs_fip", 4.0) / 20,
        "bullpen_fatigue_diff": diff("bp_app_10"),
        "weather_run_signal": (x("weather_temp_c") - 20) / 10 + x("weather_wind_kmh") / 30 - x("weather_precip_mm") / 5,
        "starter_quality_gap": quality("hs") - quality("as"),
        "starter_recency_gap": x("hs_recent_era", 4.0) - x("as_recent_era", 4.0),
        "starter_experience_gap": x("hs_starts") - x("as_starts"),
        "starter_kbb_gap": kbb("hs") - kbb("as"),
        "starter_hr_gap": x("as_hr9", 1.0) - x("hs_hr9", 1.0),
        "starter_recent_form_gap": x("as_recent_era", 4.0) - x("hs_recent_era", 4.0),
        "home_bullpen_short_rest": tired("h"), "away_bullpen_short_rest": tired("a"),
        "density_diff_3d": diff("games_last_3d"), "density_diff_7d": diff("games_last_7d"), "short_rest_diff": diff("short_rest"),
        "series_diff": diff("same_opponent_last_10"), "power_gap_10": diff("bat_hr_rate_10"), "walk_gap_10": diff("bat_bb_rate_10"),
        "contact_gap_10": contact("h") - contact("a"), "run_volatility_gap_20": diff("gf_sd_20"), "run_trend_gap_20": diff("gf_slope_20"),
    }
    return df.withColumns(out)


def run_prior(df: DataFrame, default_env: float = 7.0) -> DataFrame:
    """Structural run prior of both sides from rolling scoring, starters, power and bullpen fatigue."""
    env = _c(df, "expected_env", default_env)
    half = env / 2

    def mean_of(side: str, stat: str) -> Column:
        cols = [F.coalesce(F.col(f"{side}_{stat}_{w}"), half) if f"{side}_{stat}_{w}" in df.columns else half for w in (3, 5, 10, 20)]
        return sum(cols[1:], start=cols[0]) / 4

    band = lambda c, w: F.least(F.greatest(c, F.lit(-w)), F.lit(w))
    power = band(_c(df, "power_gap_10", 0.0) * 2.5, 0.45)
    fatigue = band(_c(df, "bullpen_fatigue_diff", 0.0) * 0.015, 0.30)
    home = 0.48 * mean_of("h", "gf") + 0.42 * mean_of("a", "ga") + 0.10 * half + 0.025 * _c(df, "home_adv", 1.0) * env
    away = 0.48 * mean_of("a", "gf") + 0.42 * mean_of("h", "ga") + 0.10 * half
    home = home + band((_c(df, "as_fip", 4.0) - 4) * 0.10, 0.55) + power - fatigue
    away = away + band((_c(df, "hs_fip", 4.0) - 4) * 0.10, 0.55) - power + fatigue
    bound = lambda c: F.least(F.greatest(0.78 * c + 0.22 * half, F.lit(0.25)), F.lit(12.0))
    return df.withColumns({"prior_home": bound(home), "prior_away": bound(away)})


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(3958.7613 * 2) * F.asin(F.sqrt(a))


def elo_expectation(diff: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -diff / F.lit(400.0)))


# ---- case risk ------------------------------------------------------------------------------------


def _finite(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(v)


def case_risk(df: DataFrame, p: str = "p") -> DataFrame:
    """Weighted uncertainty profile of each forecast; absent inputs are neutral, unknown states are risky.

    Optional columns: disagreement, conformal, drift, feature_drift, output_drift, starter_state, lineup_state,
    weather_state, roster_events, observation_count, usable_observation_count and, per side,
    <side>_rest_state, <side>_rest_days, <side>_games_3d, <side>_games_7d, <side>_travel_miles.
    """
    num = lambda n: prob.clip01(_finite(F.col(n))) if n in df.columns else F.lit(0.0)
    count = lambda n: _finite(F.col(n)) if n in df.columns else F.lit(0.0)

    def state(n: str, projected: float) -> Column:
        v = F.upper(F.col(n)) if n in df.columns else F.lit("UNKNOWN")
        return F.when(v == "VERIFIED", 0.0).when(v.isin("PROJECTED", "EXPECTED"), projected).otherwise(1.0)

    def load(side: str) -> Column:
        if f"{side}_rest_state" not in df.columns:
            return F.lit(0.0)
        get = lambda n: count(f"{side}_{n}")
        short = prob.clip01((F.lit(2.0) - get("rest_days")) / 2)
        dense = prob.clip01(F.greatest(get("games_3d") / 3, get("games_7d") / 7))
        risk = 0.45 * short + 0.35 * dense + 0.20 * prob.clip01(get("travel_miles") / 1000)
        return F.when(F.upper(F.col(f"{side}_rest_state")) == "VERIFIED", risk).otherwise(0.0)

    q = prob.scale_to_one(F.transform(F.col(p), lambda v: F.greatest(v, F.lit(1e-12))))
    base = df.withColumn("_q", q)
    ent, gap = prob.normalised_entropy(F.col("_q")), prob.top_gap_risk(F.col("_q"))
    dis, con = num("disagreement"), num("conformal")
    events = count("roster_events")
    seen, usable = count("observation_count"), count("usable_observation_count")
    starter, lineup, weather = state("starter_state", 0.35), state("lineup_state", 0.45), state("weather_state", 0.25)
    missing = F.when(seen > 0, prob.clip01(F.lit(1.0) - usable / F.nullif(seen, F.lit(0.0)))).otherwise(0.0)
    base = base.withColumns(
        {
            "probability_entropy": ent, "top_gap_risk": gap, "missing_risk": missing,
            "model_risk": prob.clip01(0.45 * ent + 0.25 * gap + 0.20 * dis + 0.10 * con),
            "data_risk": prob.clip01(0.34 * starter + 0.30 * lineup + 0.16 * weather + 0.10 * prob.clip01(0.15 * events) + 0.10 * missing),
            "drift_risk": prob.clip01(0.50 * num("drift") + 0.30 * num("feature_drift") + 0.20 * num("output_drift")),
            "instability_risk": prob.clip01(0.55 * dis + 0.45 * con),
            "situation_risk": F.greatest(load("home"), load("away")),
        }
    )
    score = prob.clip01(
        0.34 * F.col("model_risk") + 0.25 * F.col("data_risk") + 0.18 * F.col("drift_risk") + 0.13 * F.col("instability_risk") + 0.10 * F.col("situation_risk")
    )
    base = base.withColumn("risk_score", score)
    rules = {
        "high_probability_entropy": F.col("probability_entropy") >= 0.70,
        "small_top_probability_gap": F.col("top_gap_risk") >= 0.65,
        "model_disagreement": dis >= 0.60,
        "wide_conformal_uncertainty": con >= 0.60,
        "distribution_shift": F.col("drift_risk") >= 0.60,
        "lineup_information_fragile": lineup >= 0.60,
        "starter_information_fragile": starter >= 0.60,
        "weather_information_fragile": weather >= 0.60,
        "observation_coverage_gap": F.col("missing_risk") >= 0.50,
        "roster_change_signal": events > 0,
        "situational_load_or_travel_anomaly": F.col("situation_risk") >= 0.60,
    }
    return base.withColumns(
        {
            "risk_state": F.when(F.col("risk_score") >= 0.70, "HIGH").when(F.col("risk_score") >= 0.45, "MEDIUM").otherwise("LOW"),
            "reasons": F.array_compact(F.array(*[F.when(on, F.lit(n)) for n, on in rules.items()])),
            "upset_risk_signal": prob.clip01(0.40 * F.col("risk_score") + 0.25 * F.col("drift_risk") + 0.20 * dis + 0.15 * F.col("top_gap_risk")),
        }
    ).drop("_q")


def rest_travel(rows: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Rest, 3- and 7-day load and travel miles of each side, strictly before the target game.

    ``rows`` are team rows with a venue; ``coordinates`` (venue, lat, lon) is joined by key.
    """
    from matchloom.operators.form import DAY_US, TEAM, micros, weighted_within

    timed = rows.withColumn("_us", micros())
    times = timed.groupBy(*TEAM, "_us").agg(F.count(F.lit(1)).alias("_w"), F.max(F.struct("game_id", "venue")).alias("_at"))
    # State changes once per distinct time, so games at the same instant never see each other.
    line = Timeline(times, TEAM, ["_us"]).last_seen({"_prev_us": F.col("_us"), "_prev_venue": F.col("_at.venue")})
    load = weighted_within(times.select(*TEAM, "_us", "_w"), TEAM, "_us", "_w", {"games_3d": 3 * DAY_US, "games_7d": 7 * DAY_US})
    state = line.select(*TEAM, "_us", "_prev_us", "_prev_venue").join(load, [*TEAM, "_us"])
    out = timed.join(state, [*TEAM, "_us"], "left")
    here = coordinates.select("venue", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    there = coordinates.select(F.col("venue").alias("_prev_venue"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    out = out.join(here, "venue", "left").join(there, "_prev_venue", "left")
    known = F.col("_prev_us").isNotNull()
    miles = haversine_miles(F.col("_plat"), F.col("_plon"), F.col("_lat"), F.col("_lon"))
    return out.withColumns(
        {
            "rest_days": F.when(known, (F.col("_us") - F.col("_prev_us")) / F.lit(float(DAY_US))),
            "games_3d": F.when(known, F.col("games_3d")), "games_7d": F.when(known, F.col("games_7d")),
            "travel_miles": F.when(known, F.coalesce(miles, F.lit(0.0))),
            "state": F.when(known, "VERIFIED").otherwise("UNKNOWN"),
        }
    ).drop("_us", "_prev_us", "_prev_venue", "_lat", "_lon", "_plat", "_plon")


SIDE = ("rest_days", "games_3d", "games_7d", "travel_miles", "state")


def rest_travel_games(sides: DataFrame) -> DataFrame:
    """One row per game from the rows of ``rest_travel``: ``game_id, home, away`` (structs) and ``state``.

    VERIFIED needs both sides, PARTIAL has one, UNKNOWN none. A side without a row is unknown.
    """
    of = lambda is_home: F.max(F.when(F.col("is_home") == is_home, F.struct(*SIDE)))
    wide = sides.groupBy("game_id").agg(of(True).alias("home"), of(False).alias("away"))
    known = sum((F.coalesce((F.col(f"{s}.state") == "VERIFIED").cast("int"), F.lit(0)) for s in ("home", "away")), F.lit(0))
    return wide.withColumn("state", F.when(known == 2, "VERIFIED").when(known == 1, "PARTIAL").otherwise("UNKNOWN"))


def rest_observations(games: DataFrame, when: str = "datetime", tie: str = "event_id") -> DataFrame:
    """REST_TRAVEL observations of the VERIFIED games, known at ``when``; ``delta_events`` derives REST_ASYMMETRY from them.

    ``games`` has game_id, home, away, state, ``when`` and ``tie``. The value is JSON of both sides.
    """
    return games.filter("state = 'VERIFIED'").select(
        tie, "game_id", F.col(when).alias("available_at"), F.col(when).alias("prediction_time"), F.lit("REST_TRAVEL").alias("kind"), "state",
        F.to_json(F.struct("home", "away")).alias("value"),
    )
