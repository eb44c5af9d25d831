"""Registered calibration and match-day context queries, with SQL where the result is not a model fit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import prob
from matchloom.operators import calibrate, context, routing
from matchloom.plans.durable import spool
from matchloom.sources import adapters
from matchloom.sources.adapters import with_views
from matchloom.suite.history import _r, rounded
from matchloom.suite.learning import EXPERTS, FEATURES, LW
from matchloom.suite.reports import MET, NORM, P3, bundle_sql

MEASURES = ["accuracy", "logloss", "brier", "ece"]


def _p(spark, d):
    return adapters.experts(spark, d).withColumn("p", F.array(*P3))


def temperature_grid(spark, d):
    out = None
    for mode in calibrate.TEMPERATURES:
        part = calibrate.fit_temperature(_p(spark, d), ["league"], mode=mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["league", "mode"], ["temperature", "loss"])


def _temperature_sql():
    parts = []
    for mode, (grid, floor, penalty) in calibrate.TEMPERATURES.items():
        ls = f"LEAST(ln(exp(ln(p0) / t) + exp(ln(p1) / t) + exp(ln(p2) / t)) - CASE actual WHEN 0 THEN ln(p0) WHEN 1 THEN ln(p1) ELSE ln(p2) END / t, -ln({floor!r}::DOUBLE))"
        parts.append(
            f"SELECT league, '{mode}' AS mode, t, avg({ls}) + {penalty}::DOUBLE * (t - 1) * (t - 1) AS l FROM n, (SELECT unnest([{', '.join(f'{g!r}::DOUBLE' for g in grid)}]) AS t) GROUP BY 1, 2, 3"
        )
    return with_views(
        f", n AS (SELECT *, {NORM} FROM predictions), g AS ({' UNION ALL '.join(parts)}) "
        f"SELECT league, mode, {_r('arg_min(t, (round(l, 12), t))', 'temperature')}, {_r('min(l)', 'loss')} FROM g GROUP BY 1, 2"
    )


def nb_alpha_grid(spark, d):
    out = calibrate.nb_challenger(adapters.predictions(spark, d))
    return rounded(out, ["league", "rows", "test_rows", "status", "candidate_eligible"], ["alpha", "poisson_nll", "nb_nll", "score_mae"])


def _nb_sql():
    grid = ", ".join(f"{a!r}::DOUBLE" for a in calibrate.ALPHAS)
    nb = lambda y, mu: f"-(lgamma({y} + 1 / a) - lgamma(1 / a) - lgamma({y} + 1) + ln((1 / a) / (1 / a + {mu})) / a + {y} * ln(1 - (1 / a) / (1 / a + {mu})))"
    po = lambda y, mu: f"({mu} - {y} * ln({mu}) + lgamma({y} + 1))"
    loss = lambda y, mu: f"CASE WHEN a > 0 THEN {nb(y, mu)} ELSE {po(y, mu)} END"
    h, a = ("actual_home_score", "lambda_home"), ("actual_away_score", "lambda_away")
    return with_views(
        f""", w AS (SELECT *, row_number() OVER ({LW}) AS pos, count(*) OVER (PARTITION BY league) AS n FROM predictions), s AS (SELECT *, pos <= LEAST(GREATEST(floor(n * 0.6E0), 80), n - 50) AS fit FROM w),
        u AS (SELECT league, {h[0]} AS y, {h[1]} AS mu, count(*) AS c FROM s WHERE fit GROUP BY 1, 2, 3 UNION ALL SELECT league, {a[0]}, {a[1]}, count(*) FROM s WHERE fit GROUP BY 1, 2, 3),
        g AS (SELECT league, a, sum(c * ({loss('y', 'mu')})) / sum(c) AS l FROM u, (SELECT unnest([{grid}]) AS a) GROUP BY 1, 2), b AS (SELECT league, arg_min(a, (round(l, 12), a)) AS a FROM g GROUP BY 1),
        t AS (SELECT s.league, a, max(n) AS rows, count(*) AS test_rows, (avg({po(*h)}) + avg({po(*a)})) / 2 AS pn, (avg({loss(*h)}) + avg({loss(*a)})) / 2 AS nn, (avg(abs({h[0]} - {h[1]})) + avg(abs({a[0]} - {a[1]}))) / 2 AS m
          FROM s JOIN b ON b.league = s.league WHERE NOT fit GROUP BY 1, 2)
        SELECT league, rows, test_rows, 'PASS' AS status, a > 0 AND pn - nn >= 0.001 AS candidate_eligible, {_r('a', 'alpha')}, {_r('pn', 'poisson_nll')}, {_r('nn', 'nb_nll')}, {_r('m', 'score_mae')} FROM t"""
    )


def bivariate_challenger(spark, d):
    out = calibrate.bivariate_challenger(adapters.predictions(spark, d))
    return rounded(out, ["league", "rows", "test_rows", "status"], ["shared", "base_nll", "cand_nll", "base_top4", "cand_top4", "base_lh_brier", "cand_lh_brier"], 5)


def calibration_challenger(spark, d):
    return rounded(calibrate.calibration_challenger(_p(spark, d)), ["method", "rows", "eligible"], MEASURES, 4)


def upset_risk(spark, d):
    return rounded(calibrate.upset_risk(_p(spark, d), EXPERTS), ["rows", "candidate_eligible"], ["beta", "threshold", "base_logloss", "cand_logloss", "base_ece", "cand_ece"], 4)


def frozen_holdout(spark, d):
    return rounded(calibrate.frozen_holdout(_p(spark, d)), ["league", "segment", "rows"], MEASURES)


HOLDOUT_SQL = with_views(
    f""", w AS (SELECT *, {NORM}, row_number() OVER ({LW}) AS pos, count(*) OVER (PARTITION BY league) AS n FROM predictions),
    sg AS (SELECT *, CASE WHEN n < GREATEST(ceil(n * 0.15E0), 50) + 50 THEN 'deferred' WHEN pos > n - GREATEST(ceil(n * 0.15E0), 50) THEN 'holdout' ELSE 'development' END AS segment FROM w),
    {bundle_sql('sg', 'league, segment')} SELECT league, segment, rows, {MET} FROM met"""
)


# ---- context -----------------------------------------------------------------------------------------


def _obs(spark, d):
    """Observations whose availability values name player events."""
    o = adapters.observations(spark, d)
    word = F.when(F.col("value") == "0", "PLAYER_OUT").when(F.col("value") == "1", "PLAYER_RETURNED").otherwise("NONE")
    return o.withColumn("value", F.when(F.col("kind") == "AVAILABILITY", word).otherwise(F.col("value")))


OBS_SQL = """, ob AS (SELECT event_id, game_id, available_at, prediction_time, kind, state,
  CASE WHEN kind = 'AVAILABILITY' THEN CASE value WHEN '0' THEN 'PLAYER_OUT' WHEN '1' THEN 'PLAYER_RETURNED' ELSE 'NONE' END ELSE value END AS value FROM observations), ok AS (SELECT * FROM ob WHERE available_at <= prediction_time)"""


def delta_events(spark, d):
    return context.delta_events(_obs(spark, d)).select("event_id", "game_id", "event")


DELTA_SQL = OBS_SQL + """, dl AS (SELECT *, lag(state) OVER w AS os, lag(value) OVER w AS ov, lag(event_id) OVER w IS NOT NULL AS had FROM ok WINDOW w AS (PARTITION BY game_id, kind ORDER BY prediction_time, available_at, event_id)),
  de AS (SELECT event_id, game_id, prediction_time, unnest(list_filter([
    CASE WHEN kind = 'STARTER' AND state = 'VERIFIED' AND os IS DISTINCT FROM 'VERIFIED' THEN 'STARTER_CONFIRMED' END, CASE WHEN kind = 'STARTER' AND had AND ov <> value THEN 'STARTER_CHANGED' END,
    CASE WHEN kind = 'LINEUP' AND state = 'PROJECTED' AND os IS DISTINCT FROM 'PROJECTED' THEN 'LINEUP_PROJECTED' END, CASE WHEN kind = 'LINEUP' AND state = 'VERIFIED' AND os IS DISTINCT FROM 'VERIFIED' THEN 'LINEUP_CONFIRMED' END,
    CASE WHEN kind = 'WEATHER' AND had AND ov <> value THEN 'WEATHER_CHANGED' END, CASE WHEN kind = 'AVAILABILITY' AND value IN ('PLAYER_OUT', 'PLAYER_RETURNED') AND ov IS DISTINCT FROM value THEN value END], lambda x: x IS NOT NULL)) AS event FROM dl)"""


def change_events(spark, d):
    out = context.change_events(_obs(spark, d))
    return out.groupBy("game_id", "event").agg(F.count(F.lit(1)).alias("times"), F.max(F.unix_micros("prediction_time")).alias("last_us"))


def _change_sql():
    first = lambda k: f"arg_min(value, event_id) FILTER (WHERE kind = '{k}') AS v_{k}, arg_min(state, event_id) FILTER (WHERE kind = '{k}') AS s_{k}"
    kinds = ("STARTER", "LINEUP", "WEATHER", "REST_TRAVEL")
    lags = ", ".join(f"lag(v_{k}) OVER w AS pv_{k}, lag(s_{k}) OVER w AS ps_{k}" for k in kinds)
    ch = lambda k, e: f"CASE WHEN pv_{k} IS NOT NULL AND v_{k} IS NOT NULL AND pv_{k} <> v_{k} THEN '{e}' END"
    cf = lambda k, e: f"CASE WHEN s_{k} = 'VERIFIED' AND (ps_{k} IS NULL OR ps_{k} <> 'VERIFIED') THEN '{e}' END"
    return OBS_SQL + f""", sv AS (SELECT game_id, prediction_time, {', '.join(first(k) for k in kinds)}, bool_or(kind = 'AVAILABILITY' AND value = 'PLAYER_OUT') AS o, bool_or(kind = 'AVAILABILITY' AND value = 'PLAYER_RETURNED') AS b FROM ok GROUP BY 1, 2),
      lg AS (SELECT *, {lags}, lag(o) OVER w AS po, lag(b) OVER w AS pb FROM sv WINDOW w AS (PARTITION BY game_id ORDER BY prediction_time)),
      ce AS (SELECT game_id, prediction_time, unnest(list_filter([{ch('STARTER', 'STARTER_CHANGED')}, {cf('STARTER', 'STARTER_CONFIRMED')}, {ch('LINEUP', 'LINEUP_CHANGED')}, {cf('LINEUP', 'LINEUP_CONFIRMED')},
        {ch('WEATHER', 'WEATHER_CHANGED')}, CASE WHEN o AND NOT po THEN 'PLAYER_OUT' END, CASE WHEN b AND NOT pb THEN 'PLAYER_RETURNED' END, {ch('REST_TRAVEL', 'REST_TRAVEL_CHANGED')}], lambda x: x IS NOT NULL)) AS event FROM lg WHERE po IS NOT NULL)"""


def cumulative_events(spark, d):
    ev = context.delta_events(_obs(spark, d)).select("game_id", "prediction_time", "event")
    return context.cumulative_events(ev).select("game_id", "event", F.unix_micros("at").alias("at_us"))


CUMULATIVE_SQL = DELTA_SQL + """, mx AS (SELECT game_id, event, max(prediction_time) AS t FROM de GROUP BY 1, 2)
  SELECT a.game_id, a.event, epoch_us(a.t) AS at_us FROM mx a LEFT JOIN mx b ON b.game_id = a.game_id AND b.event = CASE a.event WHEN 'PLAYER_OUT' THEN 'PLAYER_RETURNED' WHEN 'LINEUP_PROJECTED' THEN 'LINEUP_CONFIRMED' END
  WHERE b.t IS NULL OR b.t < a.t"""


def _ledger(spark, d):
    """Two forecasts per game that has observations; the later one is final."""
    p = _p(spark, d)
    base = F.lit("2024-01-15 00:00:00").cast("timestamp")
    times = F.explode(F.array(base + F.expr("make_interval(0, 0, 0, cast(game_id % 10 as int))"), base - F.expr("INTERVAL 3 DAYS")))
    return p.withColumn("prediction_time", times).select("game_id", "datetime", "prediction_time", F.when(F.col("game_id") % 13 != 0, F.col("actual")).alias("actual"), "p", *EXPERTS)


def effect_dataset(spark, d):
    out = context.effect_dataset(_ledger(spark, d), _obs(spark, d))
    return out.select("game_id", "actual", *[F.col(f"ctx_{e}").cast("long").alias(f"ctx_{e}") for e in context.EVENTS])


def _dataset_sql():
    flags = ", ".join(f"CAST(COALESCE(max(CASE WHEN e.event = '{e}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS \"ctx_{e}\"" for e in context.EVENTS)
    change = _change_sql()[len(OBS_SQL):]
    return with_views(
        DELTA_SQL + change + f""", al AS (SELECT DISTINCT game_id, prediction_time, event FROM (SELECT game_id, prediction_time, event FROM de UNION ALL SELECT game_id, prediction_time, event FROM ce)),
        mx AS (SELECT game_id, event, max(prediction_time) AS t FROM al GROUP BY 1, 2),
        st AS (SELECT a.game_id, a.event FROM mx a LEFT JOIN mx b ON b.game_id = a.game_id AND b.event = CASE a.event WHEN 'PLAYER_OUT' THEN 'PLAYER_RETURNED' WHEN 'LINEUP_PROJECTED' THEN 'LINEUP_CONFIRMED' END WHERE b.t IS NULL OR b.t < a.t),
        ev AS (SELECT * FROM st UNION ALL SELECT DISTINCT game_id, 'WEATHER_PRESENT' FROM ok WHERE kind = 'WEATHER' AND state IN ('VERIFIED', 'PROJECTED') UNION ALL SELECT DISTINCT game_id, 'REST_TRAVEL_PRESENT' FROM ok WHERE kind = 'REST_TRAVEL' AND state = 'VERIFIED')
        SELECT p.game_id, any_value(p.actual) AS actual, {flags} FROM predictions p JOIN (SELECT DISTINCT game_id FROM ob) o ON o.game_id = p.game_id LEFT JOIN ev e ON e.game_id = p.game_id WHERE p.game_id % 13 <> 0 GROUP BY p.game_id"""
    )


def _flagged(spark, d):
    """Every forecast with synthetic context flags tied to the game id, so that effects have support."""
    k = F.col("game_id")
    p = _p(spark, d).withColumns({"ctx_STARTER_CHANGED": (k % 4 == 0).cast("int"), "ctx_PLAYER_OUT": (k % 6 == 1).cast("int"), "ctx_WEATHER_CHANGED": (k % 9 == 2).cast("int")})
    return context.flagged(p)


FLAG_SQL = ", fl AS (SELECT *, list_filter([CASE WHEN game_id % 4 = 0 THEN 'ctx_STARTER_CHANGED' END, CASE WHEN game_id % 6 = 1 THEN 'ctx_PLAYER_OUT' END, CASE WHEN game_id % 9 = 2 THEN 'ctx_WEATHER_CHANGED' END], lambda x: x IS NOT NULL) AS events, " + NORM + " FROM predictions)"


def event_effects(spark, d):
    out = context.fit_effects(_flagged(spark, d), ["league"])
    return rounded(out, ["league", "key", "class_index", "support"], ["coefficient"])


def _effects_sql():
    odds = lambda x: f"ln(LEAST(GREATEST({x}, 1e-5), 1 - 1e-5) / (1 - LEAST(GREATEST({x}, 1e-5), 1 - 1e-5)))"
    part = lambda c: f"SELECT league, key, CAST({c} AS BIGINT) AS class_index, n AS support, LEAST(GREATEST(({odds(f'(n{c} + 1) / (n + 3.0E0)')} - {odds(f'b{c}')}) * n / (n + 20.0E0), -0.15), 0.15) AS x FROM g WHERE n >= 25"
    return with_views(
        FLAG_SQL + """, u AS (SELECT league, actual, p0, p1, p2, unnest(events) AS key FROM fl), g AS (SELECT league, key, count(*) AS n, """
        + ", ".join(f"count(*) FILTER (WHERE actual = {c}) AS n{c}, avg(p{c}) AS b{c}" for c in range(3))
        + " FROM u GROUP BY 1, 2), a AS (" + " UNION ALL ".join(part(c) for c in range(3)) + f") SELECT league, key, class_index, support, {_r('x', 'coefficient')} FROM a WHERE abs(x) > 0.005"
    )


def _policy(spark, d):
    """Policy rows by rule from the nations table, one per event and class."""
    n = adapters.table(spark, d, "nation", "n_nationkey").filter("n_nationkey < 9")
    names = F.array(*[F.lit(x) for x in ("ctx_STARTER_CHANGED", "ctx_PLAYER_OUT", "ctx_WEATHER_CHANGED")])
    effects = n.select(
        F.element_at(names, (F.floor(F.col("n_nationkey") / 3) + 1).cast("int")).alias("key"), (F.col("n_nationkey") % 3).cast("long").alias("class_index"),
        ((F.col("n_nationkey") * 7 % 9 - 4) / 20.0).alias("coefficient"), F.lit(100).alias("support"),
    )
    return context.to_policy(effects)


def policy_apply(spark, d):
    k = F.col("game_id")
    state = F.when(k % 5 == 0, "UNKNOWN").when(k % 5 == 1, "projected").otherwise("VERIFIED")
    ctx = F.transform(F.col("events"), lambda e: F.struct(e.alias("key"), state.alias("state"), ((k % 4) / 2.0).alias("confidence")))
    out = context.apply_policy(_flagged(spark, d).withColumn("contexts", ctx), _policy(spark, d), 0.6)
    return rounded(out.withColumns({f"q{i}": F.col("decided")[i] for i in range(3)}), ["game_id"], ["q0", "q1", "q2"])


def _policy_sql():
    coef = lambda e, c: max(-0.15, min(0.15, ((3 * e + c) * 7 % 9 - 4) / 20.0))
    conf = "LEAST(GREATEST((game_id % 4) / 2.0E0, 0), 1)"
    flags = ("game_id % 4 = 0", "game_id % 6 = 1", "game_id % 9 = 2")
    sh = lambda c: f"CASE WHEN game_id % 5 = 0 THEN 0 ELSE {' + '.join(f'CASE WHEN {f} THEN LEAST(GREATEST({coef(e, c)!r}::DOUBLE * {conf}, -0.15), 0.15) ELSE 0 END' for e, f in enumerate(flags))} END"
    return with_views(
        FLAG_SQL + f", z AS (SELECT *, {', '.join(f'p{c} * exp({sh(c)}) AS z{c}' for c in range(3))} FROM fl) SELECT game_id, "
        + ", ".join(_r(f"0.4E0 * p{c} + 0.6E0 * z{c} / (z0 + z1 + z2)", f"q{c}") for c in range(3)) + " FROM z"
    )


def effect_learning(spark, d):
    """Fusion strength and two-window gate of learned effects."""
    _, gate = context.learn_effects(_flagged(spark, d))
    return rounded(gate, ["windows", "windows_passed", "candidate_eligible"], ["fusion_alpha", "tune_d_logloss", "eval_d_logloss", "eval_d_brier"])


def policy_replay(spark, d):
    out = context.replay_policy(_ledger(spark, d), _obs(spark, d), _policy(spark, d), 0.8)
    return rounded(out, ["variant", "rows"], MEASURES)


def reforecast(spark, d):
    """Routing weights, learned effects and temperature combined into one forecast."""
    e = _flagged(spark, d)
    effects = context.fit_effects(e)
    routed = routing.replay(e, EXPERTS).select("game_id", "weights", "temperature")
    out = context.reforecast(e.join(routed, "game_id"), effects, EXPERTS, 0.35)
    return rounded(out.withColumns({f"q{i}": F.col("final")[i] for i in range(3)}), ["game_id", "status"], ["q0", "q1", "q2"])


def observation_builder(spark, d):
    o = adapters.observations(spark, d, late=False)
    g = o.groupBy("game_id", "prediction_time").agg(
        *[x for t, k in (("starter", "STARTER"), ("lineup", "LINEUP"), ("weather", "WEATHER")) for x in (
            F.min_by("state", F.when(F.col("kind") == k, F.col("event_id"))).alias(f"{t}_state"), F.min_by("available_at", F.when(F.col("kind") == k, F.col("event_id"))).alias(f"{t}_available_at"),
            F.min_by("value", F.when(F.col("kind") == k, F.col("event_id"))).alias(f"{t}_value"), F.lit("feed").alias(f"{t}_source"))]
    )
    out = context.build_observations(g)
    return out.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("snapshot_id").alias("ids"), F.round(F.avg("freshness_seconds") + 1e-9, 4).alias("freshness"), F.round(F.avg("confidence") + 1e-9, 6).alias("confidence"))


BUILDER_SQL = with_views(
    """, oo AS (SELECT event_id, user_id AS game_id, ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS pt, kind, state FROM observations JOIN events USING (event_id) WHERE kind IN ('STARTER', 'LINEUP', 'WEATHER')),
    f AS (SELECT * FROM oo QUALIFY row_number() OVER (PARTITION BY game_id, pt, kind ORDER BY event_id) = 1),
    r AS (SELECT kind, state, game_id, pt, 1.0E0 AS c, 1 AS v, (epoch_us(pt) - epoch_us(ts)) / 1e6 AS fr FROM f UNION ALL SELECT kind, state, game_id, pt, CASE WHEN state = 'VERIFIED' THEN 1 WHEN kind = 'WEATHER' THEN 0.8 ELSE 0.7 END, 2, (epoch_us(pt) - epoch_us(ts)) / 1e6 FROM f WHERE state IN ('VERIFIED', 'PROJECTED'))
    SELECT kind, state, count(*) AS rows, count(DISTINCT (game_id, pt, v)) AS ids, ROUND(avg(fr) + 1e-9, 4) AS freshness, ROUND(avg(c) + 1e-9, 6) AS confidence FROM r GROUP BY 1, 2"""
)


def integrated_gate(spark, d):
    e = _flagged(spark, d)
    routed = spool(routing.replay(e, EXPERTS).select(*routing.REPORTED), "replay")
    gate = routing.acceptance_gate(routing.replay_report(e, routed))
    effects, learned = context.learn_effects(e)
    rep = context.replay_policy(_ledger(spark, d), _obs(spark, d), context.to_policy(effects), 0.8)
    return context.integrated_gate(gate, learned, rep).select("routing_gate", "effect_gate", "forward_replay_gate", "candidate_eligible", "status")


def promotion_gate(spark, d):
    from matchloom.operators import reports

    e = _p(spark, d)
    pair = F.explode(F.array(F.struct(F.lit("base").alias("v"), F.col("p").alias("q")), F.struct(F.lit("expert_0").alias("v"), F.col("expert_0").alias("q"))))
    long = e.select("actual", F.col("p").alias("before"), pair.alias("x")).select("actual", "before", "x.v", "x.q")
    # Uncertain games: the baseline's favourite lies below 45 %.
    high = long.filter(F.array_max("before") < 0.45)
    evidence = e.select(
        F.col("actual").isNotNull().alias("oos"), (F.count(F.lit(1)).over(Window.partitionBy("league")) >= 200).alias("two_validation_windows"),
        F.abs(F.expr("aggregate(p, 0D, (a, x) -> a + x)") - 1).__lt__(1e-9).alias("calibration_check"),
    )
    bundle = lambda rows: reports.metric_bundle(rows, ["v"], "q")
    return context.promotion_gate(bundle(long), "v", "base", "expert_0", bundle(high), evidence)


def _promotion_sql():
    from matchloom.suite.scores import experts_sql

    mass = "(pred_home + pred_draw + pred_away)"
    held = ", ".join(f"'{n}'" for n in context.REQUIRED)
    shown = ", ".join("(SELECT bool_and(n >= 200) FROM size)" if n == "two_validation_windows" else "true" if n in ("oos", "calibration_check") else "false" for n in context.REQUIRED)
    return with_views(
        experts_sql() + f""", lg AS (SELECT 'base' AS v, actual, pred_home / {mass} AS p0, pred_draw / {mass} AS p1, pred_away / {mass} AS p2, GREATEST(pred_home, pred_draw, pred_away) / {mass} AS top FROM experts
          UNION ALL SELECT 'cand', actual, e0_0, e0_1, e0_2, GREATEST(pred_home, pred_draw, pred_away) / {mass} FROM experts), {bundle_sql('lg', 'v')}, b AS (SELECT * FROM met WHERE v = 'base'), c AS (SELECT * FROM met WHERE v = 'cand'),
        hs AS (SELECT avg(-ln(GREATEST(CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12))) FILTER (WHERE v = 'cand') - avg(-ln(GREATEST(CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12))) FILTER (WHERE v = 'base') AS gap FROM lg WHERE top < 0.45),
        size AS (SELECT league, count(*) AS n FROM experts GROUP BY league)
        SELECT unnest(['min_rows', 'relative_gain', 'logloss', 'brier', 'accuracy', 'ece']) AS check, unnest([c.rows >= 200, (b.logloss - c.logloss) / b.logloss >= 0.01, c.logloss - b.logloss <= 0.005, c.brier - b.brier <= 0.005, c.accuracy - b.accuracy >= -0.005, c.ece - b.ece <= 0.01]) AS passed FROM b, c
        UNION ALL SELECT 'high_state', gap <= 0.01 FROM hs UNION ALL SELECT unnest([{held}]), unnest([{shown}])"""
    )


QUERIES = {
    "temperature_grid": temperature_grid, "nb_alpha_grid": nb_alpha_grid, "bivariate_challenger": bivariate_challenger, "isotonic_platt": calibration_challenger,
    "upset_risk": upset_risk, "frozen_holdout": frozen_holdout, "delta_events": delta_events, "change_events": change_events, "cumulative_events": cumulative_events,
    "effect_dataset": effect_dataset, "event_effects": event_effects, "policy_apply": policy_apply, "effect_learning": effect_learning, "policy_replay": policy_replay,
    "reforecast": reforecast, "observation_builder": observation_builder, "integrated_gate": integrated_gate, "promotion_gate": promotion_gate,
}
ORACLES = {
    "temperature_grid": _temperature_sql(), "nb_alpha_grid": _nb_sql(), "frozen_holdout": HOLDOUT_SQL,
    "delta_events": with_views(DELTA_SQL + " SELECT event_id, game_id, event FROM de"),
    "change_events": with_views(_change_sql() + " SELECT game_id, event, count(*) AS times, epoch_us(max(prediction_time)) AS last_us FROM ce GROUP BY 1, 2"),
    "cumulative_events": with_views(CUMULATIVE_SQL), "effect_dataset": _dataset_sql(), "event_effects": _effects_sql(), "policy_apply": _policy_sql(),
    "observation_builder": BUILDER_SQL, "promotion_gate": _promotion_sql(),
}
