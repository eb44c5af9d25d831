"""Registered score-distribution, probability and risk queries, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from matchloom.functions import dist, prob
from matchloom.operators import context, form, scorelines
from matchloom.plans.durable import spool
from matchloom.sources import adapters, store
from matchloom.sources.adapters import with_views
from matchloom.suite.history import _r, rounded
from matchloom.suite.reports import CELLS_SQL, NORM, cdf, pois

ID = ["game_id"]


def _flat(df, n):
    c = lambda i: F.element_at("candidates", i)
    cols = [c(i)["label"].alias(f"score{i}") for i in range(1, n + 1)] + [F.round(c(i)["p"], 6).alias(f"prob{i}") for i in range(1, n + 1)]
    return df.select("game_id", *cols)


def top4_scores(spark, d):
    return _flat(scorelines.score_candidates(adapters.predictions(spark, d)), 4)


FLAT = ", ".join([f"max(t.label) FILTER (WHERE t.rn = {i}) AS score{i}" for i in range(1, 5)] + [f"ROUND(max(t.p) FILTER (WHERE t.rn = {i}), 6) AS prob{i}" for i in range(1, 5)])
TOP4_SQL = with_views(
    f""", {CELLS_SQL}, w AS (SELECT lh, la, {FLAT} FROM top4 t GROUP BY lh, la)
    SELECT game_id, w.* EXCLUDE (lh, la) FROM predictions JOIN w ON lh = lambda_home AND la = lambda_away"""
)


def top_cells(spark, d):
    """Exact-cell candidates of the renormalised 21 x 21 grid."""
    return _flat(scorelines.score_candidates(adapters.predictions(spark, d), mode="cells_21"), 4)


CELLS21_SQL = with_views(
    ", " + CELLS_SQL.replace("range(7)", "range(21)").replace("every AS (SELECT * FROM cells UNION ALL SELECT lh, la, 999, 999, GREATEST(1 - sum(p), 0), 1 FROM cells GROUP BY lh, la)",
        "every AS (SELECT lh, la, h, a, p / sum(p) OVER (PARTITION BY lh, la) AS p, 0 AS o FROM cells)")
    + f", w AS (SELECT lh, la, {FLAT} FROM top4 t GROUP BY lh, la) SELECT game_id, w.* EXCLUDE (lh, la) FROM predictions JOIN w ON lh = lambda_home AND la = lambda_away"
)


def low_high_modes(spark, d):
    p = adapters.predictions(spark, d)
    h, a = F.col("lambda_home"), F.col("lambda_away")
    line = dist.line_probs(h, a, (F.col("game_id") % 24) / 2.0)
    out = p.withColumns(
        {
            "low_total": scorelines.low_high(h, a), "low_truncated": scorelines.low_high(h, a, "truncated"), "low_both": scorelines.low_high(h, a, "both"),
            "low_nb": scorelines.low_high(h, a, "both", F.lit(3.5), F.lit(8.0)), "low_line": line["low"], "high_line": line["high"],
        }
    )
    return rounded(out, ID, ["low_total", "low_truncated", "low_both", "low_nb", "low_line", "high_line"])


def _nb_pmf(k, mu, size):
    return f"exp(lgamma({k} + {size}) - lgamma({size}) - lgamma({k} + 1) + {size} * ln({size} / ({size} + {mu})) + {k} * ln(1 - {size} / ({size} + {mu})))"


def _low_high_sql():
    lh, la, t = "lambda_home", "lambda_away", "(lambda_home + lambda_away)"
    nb = lambda mu, s: "(" + " + ".join(_nb_pmf(k, mu, s) for k in range(7)) + ")"
    line = "(game_id % 24) / 2.0E0"
    upto = " + ".join(f"CASE WHEN {k} < {line} THEN {pois(k, t)} ELSE 0 END" for k in range(12))
    half = f"game_id % 2 = 1"
    return with_views(
        f"""SELECT game_id, {_r(cdf(t, 6), 'low_total')}, {_r(f'{cdf(t, 6)} / {cdf(t, 30)}', 'low_truncated')}, {_r(f'{cdf(lh, 6)} * {cdf(la, 6)}', 'low_both')},
        {_r(f"{nb(lh, '3.5E0')} * {nb(la, '8.0E0')}", 'low_nb')}, {_r(f'CASE WHEN {half} THEN {upto} END', 'low_line')}, {_r(f'CASE WHEN {half} THEN 1 - ({upto}) END', 'high_line')} FROM predictions"""
    )


SHARED = 0.4


def bivariate_grid(spark, d):
    p = scorelines.bivariate_candidates(adapters.predictions(spark, d), F.lit(SHARED))
    out = p.withColumns(
        {
            "nll": scorelines.categorical_nll(F.col("space"), F.col("actual_home_score"), F.col("actual_away_score")),
            "low": dist.low_bivariate(F.col("lambda_home"), F.col("lambda_away"), F.lit(SHARED)), "score1": F.element_at("candidates", 1)["label"],
        }
    )
    return rounded(out, ["game_id", "score1"], ["nll", "low"])


BIVARIATE_SQL = with_views(
    f""", scored AS MATERIALIZED (SELECT game_id, lambda_home, lambda_away, actual_home_score, actual_away_score FROM predictions), lams AS MATERIALIZED (SELECT DISTINCT lambda_home AS lh, lambda_away AS la FROM scored), k AS (SELECT range AS k FROM range(7)),
    cells AS MATERIALIZED (SELECT lh, la, h.k AS h, a.k AS a, sum(exp(-(lh - {SHARED}) + (h.k - s.k) * ln(lh - {SHARED}) - lgamma(h.k - s.k + 1))
       * exp(-(la - {SHARED}) + (a.k - s.k) * ln(la - {SHARED}) - lgamma(a.k - s.k + 1)) * exp(-{SHARED}::DOUBLE + s.k * ln({SHARED}::DOUBLE) - lgamma(s.k + 1))) AS p, 0 AS o
       FROM lams, k h, k a, k s WHERE s.k <= LEAST(h.k, a.k) GROUP BY 1, 2, 3, 4),
    every AS MATERIALIZED (SELECT * FROM cells UNION ALL SELECT lh, la, 999, 999, GREATEST(1 - sum(p), 0), 1 FROM cells GROUP BY lh, la),
    nrm AS MATERIALIZED (SELECT lh, la, h, a, o, p / sum(p) OVER (PARTITION BY lh, la) AS p FROM every),
    best AS MATERIALIZED (SELECT lh, la, CASE WHEN o = 1 THEN 'OTHER' ELSE h || '-' || a END AS score1 FROM nrm QUALIFY row_number() OVER (PARTITION BY lh, la ORDER BY round(p, 12) DESC, o, h, a) = 1)
    SELECT game_id, score1, {_r('-ln(GREATEST(n.p, 1e-12))', 'nll')},
      {_r(' + '.join(f"{pois(j, str(SHARED) + '::DOUBLE')} * {cdf(f'lambda_home + lambda_away - {2 * SHARED}', 6 - 2 * j)}" for j in range(4)), 'low')}
    FROM scored JOIN best b ON b.lh = lambda_home AND b.la = lambda_away JOIN nrm n ON n.lh = lambda_home AND n.la = lambda_away
      AND n.h = CASE WHEN actual_home_score >= 7 OR actual_away_score >= 7 THEN 999 ELSE actual_home_score END
      AND n.a = CASE WHEN actual_home_score >= 7 OR actual_away_score >= 7 THEN 999 ELSE actual_away_score END"""
)


def candidate_contract(spark, d):
    li = adapters.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    c = li.select(
        F.col("l_orderkey").alias("event_id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), (F.col("l_orderkey") % 3).cast("string")).alias("score"),
        F.when(F.col("l_discount") > 0.095, 1.5).otherwise(F.col("l_discount")).alias("probability"),
    )
    return scorelines.candidate_contract(c)


CONTRACT_SQL = """WITH c AS (SELECT l_orderkey AS event_id, l_linenumber || '-' || (l_orderkey % 3) AS score, CASE WHEN l_discount > 0.095 THEN 1.5 ELSE l_discount END AS p FROM lineitem),
 l AS (SELECT event_id, score, max(p) AS probability, count(*) AS n, count(*) FILTER (WHERE p > 1) AS bad FROM c GROUP BY 1, 2),
 k AS (SELECT event_id, CAST(sum(bad) AS BIGINT) AS bad_values, count(*) FILTER (WHERE n > 1) AS repeated_labels FROM l GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY probability DESC, score) AS rank FROM l)
SELECT r.event_id, rank, score, probability, bad_values, repeated_labels FROM r JOIN k ON k.event_id = r.event_id WHERE rank <= 4"""


def mom_top3(spark, d):
    p = adapters.player_games(spark, d).select(
        F.col("game_id").alias("match_id"), "player_id", F.when(F.col("game_id") % 20 != 0, F.col("h") * 2 + F.col("hr")).alias("score_proxy"), (F.col("h") / 20.0).alias("prob")
    )
    return scorelines.top_players(p)


def _mom_sql():
    from matchloom.suite.history import PLAYER_SQL

    return f"""WITH {PLAYER_SQL}, r AS (SELECT game_id, player_id, h, row_number() OVER (PARTITION BY game_id ORDER BY h * 2 + hr DESC, player_id) AS rank FROM player_games WHERE game_id % 20 <> 0),
    m AS (SELECT DISTINCT game_id FROM player_games)
    SELECT m.game_id AS match_id, rank, player_id, ROUND(h / 20.0E0 * 100, 2) AS probability_pct, CASE WHEN rank IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status
    FROM m LEFT JOIN r ON r.game_id = m.game_id AND rank <= 3"""


def model_weights(spark, d):
    p = adapters.predictions(spark, d)
    losses = p.groupBy("league", "model").agg(F.avg(-F.ln("pred_home")).alias("loss"))
    return rounded(scorelines.inverse_loss_weights(losses, ["league"], 2), ["league", "model", "rank"], ["loss", "weight"])


WEIGHTS_SQL = with_views(
    f""", l AS (SELECT league, model, avg(-ln(pred_home)) AS loss FROM predictions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY loss, model) AS rank FROM l QUALIFY rank <= 2)
    SELECT league, model, rank, {_r('loss', 'loss')}, {_r('(1 / loss) / sum(1 / loss) OVER (PARTITION BY league)', 'weight')} FROM r"""
)


def recent_tail(spark, d):
    """The last twenty forecasts in total order (a top-k report)."""
    p = adapters.predictions(spark, d)
    return p.orderBy(F.col("datetime").desc(), F.col("game_id").desc()).limit(20).select("game_id", "league", "actual")


TAIL_SQL = with_views("SELECT game_id, league, actual FROM predictions ORDER BY datetime DESC, game_id DESC LIMIT 20")


def history_cap(spark, d):
    p = adapters.predictions(spark, d).select("game_id", "datetime", "model")
    out = store.bounded_history(p.filter("game_id % 2 = 0"), p.filter("game_id % 2 = 1"), ["datetime", "game_id"], 500)
    return out.select("game_id", "model")


CAP_SQL = with_views("SELECT game_id, model FROM predictions ORDER BY datetime DESC, game_id DESC LIMIT 500")


def vector_algebra(spark, d):
    """Clipping, tempering, softmax, logit shift, entropy, gap risk and disagreement of forecasts."""
    e = adapters.experts(spark, d)
    raw = F.array(F.col("pred_home"), F.when(F.col("game_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("pred_draw")), F.col("pred_away"))
    es = [F.col(f"expert_{j}") for j in range(3)]
    out = e.withColumns(
        {
            "clip": prob.clip_prob(raw), "temp": prob.temper(F.array("pred_home", "pred_draw", "pred_away"), 1.4),
            "soft": prob.softmax(F.array("lambda_home", "lambda_away"), 0.8), "mixed": prob.mix(es, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.4))),
            "dis": prob.disagreement(es),
        }
    )
    out = out.withColumns(
        {
            "clip_draw": F.col("clip")[1], "temp_home": F.col("temp")[0], "soft_home": F.col("soft")[0], "mix_away": F.col("mixed")[2],
            "entropy": prob.normalised_entropy(F.col("temp")), "gap_risk": prob.top_gap_risk(F.col("temp")),
            "shifted": prob.sigmoid(prob.logit(F.col("pred_home")) + 0.1), "shrunk": prob.shrink_by_risk(F.col("temp"), F.col("pred_draw"), 0.75)[0],
            "elo_p": scorelines.elo_expectation(F.col("lambda_home") * 100 - 150),
        }
    )
    return rounded(out, ID, ["clip_draw", "temp_home", "soft_home", "mix_away", "dis", "entropy", "gap_risk", "shifted", "shrunk", "elo_p"])


def experts_sql() -> str:
    cols = []
    for j, (hm, hb, dm, db) in enumerate(adapters.EXPERT_MODS):
        h, dr = f"(game_id % {hm} + {hb}) / 100.0E0", f"(game_id % {dm} + {db}) / 100.0E0"
        cols += [f"{h} AS e{j}_0", f"{dr} AS e{j}_1", f"1 - {h} - {dr} AS e{j}_2"]
    return f", experts AS (SELECT *, {', '.join(cols)} FROM predictions)"


def _algebra_sql():
    t = [f"power(q{i}, 1 / 1.4E0)" for i in range(3)]
    tz = "(" + " + ".join(t) + ")"
    sd = lambda i: f"list_stddev_pop([e0_{i}, e1_{i}, e2_{i}])"
    mixed = [f"(0.5 * e0_{i} + 0.3 * e1_{i} + 0.4 * e2_{i}) / 1.2E0" for i in range(3)]
    ent = "-(" + " + ".join(f"t{i} * ln(t{i})" for i in range(3)) + ") / ln(3.0E0)"
    srt = "list_reverse_sort([t0, t1, t2])"
    sh = [f"power(t{i}, 1 / (1 + 0.75E0 * pred_draw))" for i in range(3)]
    third = "(1 / 3.0E0)"
    return with_views(
        experts_sql() + f""", q AS (SELECT *, pred_home / (pred_home + pred_draw + pred_away) AS q0, pred_draw / (pred_home + pred_draw + pred_away) AS q1, pred_away / (pred_home + pred_draw + pred_away) AS q2 FROM experts),
        t AS (SELECT *, {t[0]} / {tz} AS t0, {t[1]} / {tz} AS t1, {t[2]} / {tz} AS t2 FROM q)
        SELECT game_id, {_r(f'CASE WHEN game_id % 50 = 0 THEN {third} / (pred_home + {third} + pred_away) ELSE pred_draw END', 'clip_draw')}, {_r('t0', 'temp_home')},
          {_r('1 / (1 + exp((lambda_away - lambda_home) / 0.8E0))', 'soft_home')}, {_r(mixed[2], 'mix_away')}, {_r(f'({sd(0)} + {sd(1)} + {sd(2)}) / 3', 'dis')},
          {_r(ent, 'entropy')}, {_r(f'LEAST(GREATEST(1 - ({srt}[1] - {srt}[2]) / 0.25E0, 0), 1)', 'gap_risk')},
          {_r('1 / (1 + exp(-(ln(pred_home / (1 - pred_home)) + 0.1E0)))', 'shifted')}, {_r(f'{sh[0]} / ({sh[0]} + {sh[1]} + {sh[2]})', 'shrunk')},
          {_r('1 / (1 + power(10, -(lambda_home * 100 - 150) / 400))', 'elo_p')} FROM t"""
    )


def case_risk(spark, d):
    e = adapters.experts(spark, d)
    k = F.col("game_id")
    e = e.withColumns(
        {
            "p": F.array("pred_home", "pred_draw", "pred_away"), "disagreement": (k % 10) / 9.0, "conformal": (k % 7) / 6.0, "drift": (k % 5) / 4.0,
            "feature_drift": (k % 3) / 2.0, "output_drift": (k % 11) / 10.0, "starter_state": F.when(k % 4 == 0, "verified").when(k % 4 == 1, "PROJECTED").otherwise("UNKNOWN"),
            "lineup_state": F.when(k % 5 == 0, "VERIFIED").when(k % 5 == 1, "EXPECTED"), "roster_events": k % 3, "observation_count": k % 6, "usable_observation_count": k % 4,
            "home_rest_state": F.when(k % 2 == 0, "VERIFIED").otherwise("UNKNOWN"), "home_rest_days": (k % 4).cast("double"), "home_games_3d": k % 4, "home_games_7d": k % 8,
            "home_travel_miles": (k % 1500).cast("double"),
        }
    )
    out = scorelines.case_risk(e)
    out = out.withColumn("reasons", F.size("reasons").cast("long"))
    return rounded(out, ["game_id", "risk_state", "reasons"], ["risk_score", "upset_risk_signal", "model_risk", "data_risk", "drift_risk", "situation_risk"])


def _risk_sql():
    c01 = lambda e: f"LEAST(GREATEST({e}, 0), 1)"
    return with_views(
        f""", n AS (SELECT game_id, {NORM}, (game_id % 10) / 9.0E0 AS dis, (game_id % 7) / 6.0E0 AS con, CASE game_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.35E0 ELSE 1 END AS st,
           CASE game_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0.45E0 ELSE 1 END AS li, game_id % 3 AS ev, game_id % 6 AS oc, game_id % 4 AS uc FROM predictions),
        a AS (SELECT *, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3.0E0) AS ent, {c01('1 - (list_reverse_sort([p0, p1, p2])[1] - list_reverse_sort([p0, p1, p2])[2]) / 0.25E0')} AS gap,
           CASE WHEN oc > 0 THEN {c01('1 - uc / oc::DOUBLE')} ELSE 0 END AS mi, 0.5E0 * ((game_id % 5) / 4.0E0) + 0.3E0 * ((game_id % 3) / 2.0E0) + 0.2E0 * ((game_id % 11) / 10.0E0) AS dr,
           CASE WHEN game_id % 2 = 0 THEN 0.45E0 * {c01('(2 - game_id % 4) / 2.0E0')} + 0.35E0 * {c01('GREATEST((game_id % 4) / 3.0E0, (game_id % 8) / 7.0E0)')} + 0.2E0 * {c01('(game_id % 1500) / 1000.0E0')} ELSE 0 END AS si FROM n),
        b AS (SELECT *, {c01('0.45E0 * ent + 0.25E0 * gap + 0.2E0 * dis + 0.1E0 * con')} AS mr, {c01('0.34E0 * st + 0.3E0 * li + 0.16E0 + 0.1E0 * LEAST(0.15E0 * ev, 1) + 0.1E0 * mi')} AS da FROM a),
        c AS (SELECT *, {c01('0.34E0 * mr + 0.25E0 * da + 0.18E0 * dr + 0.13E0 * (0.55E0 * dis + 0.45E0 * con) + 0.1E0 * si')} AS sc FROM b)
        SELECT game_id, CASE WHEN sc >= 0.7 THEN 'HIGH' WHEN sc >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_state,
          CAST((ent >= 0.7)::INT + (gap >= 0.65)::INT + (dis >= 0.6)::INT + (con >= 0.6)::INT + (dr >= 0.6)::INT + (li >= 0.6)::INT + (st >= 0.6)::INT + 1 + (mi >= 0.5)::INT + (ev > 0)::INT + (si >= 0.6)::INT AS BIGINT) AS reasons,
          {_r('sc', 'risk_score')}, {_r(c01('0.4E0 * sc + 0.25E0 * dr + 0.2E0 * dis + 0.15E0 * gap'), 'upset_risk_signal')}, {_r('mr', 'model_risk')}, {_r('da', 'data_risk')}, {_r('dr', 'drift_risk')}, {_r('si', 'situation_risk')} FROM c"""
    )


def matchup(spark, d):
    """Match-up interactions and the structural run prior over ten-game form."""
    rows = form.rest_days(form.rolling_form(form.team_rows(adapters.matches(spark, d)), [3, 5, 10, 20]))
    names = [f"{s}_{w}" for s in ("gf", "ga") for w in (3, 5, 10, 20)] + ["rest_days", "short_rest"]
    wide = form.game_differences(rows, names)
    out = scorelines.run_prior(scorelines.matchup_features(wide))
    adj = dist.consistency_adjust(F.col("prior_home"), (F.col("h_gf_10") - F.col("a_gf_10")) / 10, 1)
    return rounded(out.withColumn("adjusted_home", adj), ID, ["expected_env", "short_rest_diff", "starter_quality_gap", "prior_home", "prior_away", "adjusted_home"], 5)


def _matchup_sql():
    from matchloom.suite.history import ELIGIBLE, W

    st = ", ".join(f"avg({s}) OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {s}_{w}" for s in ("gf", "ga") for w in (3, 5, 10, 20))
    cols = ", ".join(f"COALESCE(l.{s}_{w}, 0) AS {s}_{w}" for s in ("gf", "ga") for w in (3, 5, 10, 20))
    mean = lambda side, s: "(" + " + ".join(f"{side}.{s}_{w}" for w in (3, 5, 10, 20)) + ") / 4"
    r5 = lambda e, n: _r(e, n, 5)
    return with_views(
        "," + ELIGIBLE.format(w=W, src="team_rows") + f""", st AS (SELECT league, team, idx, datetime, {st} FROM live),
        f AS MATERIALIZED (SELECT s.game_id, s.is_home, {cols}, COALESCE(GREATEST((epoch_us(s.datetime) - epoch_us(l.datetime)) / 86400000000.0E0, 0), 30) < 2 AS sr
          FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n),
        j AS MATERIALIZED (SELECT game_id, LEAST(GREATEST(0.5E0 * (h.gf_10 + a.gf_10 + h.ga_10 + a.ga_10), 0.5), 12) AS env, h.sr::INT - a.sr::INT AS srd, {mean('h', 'gf')} AS ho, {mean('a', 'ga')} AS ad, {mean('a', 'gf')} AS ao, {mean('h', 'ga')} AS hd,
           h.gf_10 - a.gf_10 AS gd FROM (SELECT * FROM f WHERE is_home) h JOIN (SELECT * FROM f WHERE NOT is_home) a USING (game_id)),
        p AS (SELECT *, LEAST(GREATEST(0.78E0 * (0.48E0 * ho + 0.42E0 * ad + 0.1E0 * env / 2 + 0.025E0 * env) + 0.22E0 * env / 2, 0.25), 12) AS ph,
           LEAST(GREATEST(0.78E0 * (0.48E0 * ao + 0.42E0 * hd + 0.1E0 * env / 2) + 0.22E0 * env / 2, 0.25), 12) AS pa FROM j)
        SELECT game_id, {r5('env', 'expected_env')}, {r5('srd', 'short_rest_diff')}, 0.0E0 AS starter_quality_gap, {r5('ph', 'prior_home')}, {r5('pa', 'prior_away')},
          {r5('ph * (1 + 0.08E0 * LEAST(GREATEST(gd / 10, -0.35), 0.35))', 'adjusted_home')} FROM p"""
    )


def _venues(spark):
    """Coordinates of the twelve venues by rule."""
    i = F.col("id")
    return spark.range(12).select(F.concat(F.lit("V"), i.cast("string")).alias("venue"), (F.lit(30.0) + i * 1.1).alias("lat"), (F.lit(-120.0) + i * 3.7).alias("lon"))


def rest_travel(spark, d):
    g = adapters.matches(spark, d)
    rows = form.team_rows(g).join(g.select("game_id", "venue"), "game_id")
    out = scorelines.rest_travel(rows, _venues(spark).filter("venue <> 'V5'"))
    return rounded(out, ["game_id", "team", "state", "games_3d", "games_7d"], ["rest_days", "travel_miles"], 4)


def rest_travel_games(spark, d):
    """Both sides of a game, its state, and whether a REST_ASYMMETRY event follows from it."""
    g = adapters.matches(spark, d)
    rows = form.team_rows(g).join(g.select("game_id", "venue"), "game_id")
    games = spool(scorelines.rest_travel_games(scorelines.rest_travel(rows, _venues(spark).filter("venue <> 'V5'"))), "rest-games")
    # Both sides of these joins have a row per game; the written table looks small, as it is compressed, but is never broadcast.
    start = g.select("game_id", F.col("datetime").cast("timestamp").alias("datetime"))
    timed = games.join(start.hint("merge"), "game_id").withColumn("event_id", F.col("game_id"))
    events = context.delta_events(scorelines.rest_observations(timed)).select("game_id", "event")
    out = games.join(events.hint("merge"), "game_id", "left").select(
        "game_id", "state", "event", F.col("home.games_7d").alias("home_games_7d"), F.col("away.games_7d").alias("away_games_7d"),
        F.col("home.rest_days").alias("home_rest"), F.col("away.rest_days").alias("away_rest"), F.col("home.travel_miles").alias("home_miles"), F.col("away.travel_miles").alias("away_miles"),
    )
    return rounded(out, ["game_id", "state", "event", "home_games_7d", "away_games_7d"], ["home_rest", "away_rest", "home_miles", "away_miles"], 4)


def _travel_games_sql():
    sides = _travel_sql()
    cut = sides.rindex("SELECT k.game_id")
    inner = sides[cut:].replace("SELECT k.game_id, k.team,", "SELECT k.game_id, k.is_home,")
    return sides[:cut].rstrip() + f""", sd AS MATERIALIZED ({inner})
        SELECT h.game_id, CASE WHEN h.state = 'VERIFIED' AND a.state = 'VERIFIED' THEN 'VERIFIED' WHEN h.state = 'VERIFIED' OR a.state = 'VERIFIED' THEN 'PARTIAL' ELSE 'UNKNOWN' END AS state,
          CASE WHEN h.state = 'VERIFIED' AND a.state = 'VERIFIED' AND h.rest_days <> a.rest_days THEN 'REST_ASYMMETRY' END AS event, h.games_7d AS home_games_7d, a.games_7d AS away_games_7d,
          h.rest_days AS home_rest, a.rest_days AS away_rest, h.travel_miles AS home_miles, a.travel_miles AS away_miles
        FROM (SELECT * FROM sd WHERE is_home) h JOIN (SELECT * FROM sd WHERE NOT is_home) a USING (game_id)"""


def _travel_sql():
    hav = "3958.7613E0 * 2 * asin(sqrt(power(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lon - p.lon) / 2), 2)))"
    cnt = lambda n: f"count(*) OVER (PARTITION BY t.league, t.team ORDER BY t.datetime RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    return with_views(
        f""", v AS (SELECT 'V' || range AS venue, 30.0E0 + range * 1.1E0 AS lat, -120.0E0 + range * 3.7E0 AS lon FROM range(12) WHERE range <> 5),
        t AS (SELECT r.*, m.venue FROM team_rows r JOIN matches m ON m.game_id = r.game_id),
        g AS (SELECT league, team, datetime, arg_max(venue, game_id) AS venue FROM t GROUP BY 1, 2, 3),
        l AS (SELECT league, team, datetime, lag(datetime) OVER w AS pd, lag(venue) OVER w AS pv FROM g WINDOW w AS (PARTITION BY league, team ORDER BY datetime)),
        k AS (SELECT t.*, {cnt(3)} AS g3, {cnt(7)} AS g7 FROM t)
        SELECT k.game_id, k.team, CASE WHEN pd IS NULL THEN 'UNKNOWN' ELSE 'VERIFIED' END AS state, CASE WHEN pd IS NOT NULL THEN g3 END AS games_3d, CASE WHEN pd IS NOT NULL THEN g7 END AS games_7d,
          {_r('(epoch_us(k.datetime) - epoch_us(pd)) / 86400000000.0E0', 'rest_days', 4)}, {_r(f'CASE WHEN pd IS NOT NULL THEN COALESCE({hav}, 0) END', 'travel_miles', 4)}
        FROM k JOIN l ON l.league = k.league AND l.team = k.team AND l.datetime = k.datetime LEFT JOIN v c ON c.venue = k.venue LEFT JOIN v p ON p.venue = l.pv"""
    )


QUERIES = {
    "top4_scores": top4_scores, "top_cells": top_cells, "low_high_modes": low_high_modes, "bivariate_grid": bivariate_grid, "candidate_contract": candidate_contract,
    "mom_top3": mom_top3, "model_weights": model_weights, "recent_tail": recent_tail, "history_cap": history_cap, "vector_algebra": vector_algebra,
    "case_risk": case_risk, "matchup_prior": matchup, "rest_travel": rest_travel, "rest_travel_games": rest_travel_games,
}
ORACLES = {
    "top4_scores": TOP4_SQL, "top_cells": CELLS21_SQL, "low_high_modes": _low_high_sql(), "bivariate_grid": BIVARIATE_SQL, "candidate_contract": CONTRACT_SQL,
    "mom_top3": _mom_sql(), "model_weights": WEIGHTS_SQL, "recent_tail": TAIL_SQL, "history_cap": CAP_SQL, "vector_algebra": _algebra_sql(), "case_risk": _risk_sql(),
    "matchup_prior": _matchup_sql(), "rest_travel": _travel_sql(), "rest_travel_games": _travel_games_sql(),
}
