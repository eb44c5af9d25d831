"""Registered drift, rating, calibration and routing queries; SQL where the result is not a recursion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from matchloom.functions import prob
from matchloom.operators import drift, rating, routing
from matchloom.plans.durable import spool
from matchloom.sources import adapters
from matchloom.sources.adapters import with_views
from matchloom.suite.history import _r, rounded
from matchloom.suite.reports import NORM, P3, PICK, SCORED_SQL, bundle_sql
from matchloom.suite.scores import experts_sql

EXPERTS = ["expert_0", "expert_1", "expert_2"]
FEATURES = ["feature_rest", "feature_form", "feature_env"]
LW = "PARTITION BY league ORDER BY datetime, game_id"
FEATURE_SQL = ", fx AS (SELECT *, CAST(game_id % 23 AS DOUBLE) AS f0, CAST((game_id * 7) % 31 AS DOUBLE) / 10 AS f1, CAST((game_id * 3) % 19 AS DOUBLE) / 5 AS f2 FROM predictions)"


def output_drift(spark, d):
    return rounded(drift.output_drift(adapters.experts(spark, d), EXPERTS), ["game_id"], ["output_drift"])


def _output_sql():
    es = [f"e{j}_{i}" for j in range(3) for i in range(3)]
    a = ", ".join(f"avg({e}) OVER ({LW} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS r_{e}, avg({e}) OVER ({LW} ROWS BETWEEN 96 PRECEDING AND 13 PRECEDING) AS o_{e}" for e in es)
    moved = "(" + " + ".join(f"abs(r_{e} - o_{e})" for e in es) + ") / 9"
    now = "(" + " + ".join(f"abs({e} - r_{e})" for e in es) + ") / 9"
    return with_views(
        experts_sql() + f""", w AS (SELECT *, row_number() OVER ({LW}) - 1 AS n, {a} FROM experts)
        SELECT game_id, {_r(f'CASE WHEN n >= 24 THEN LEAST(GREATEST(1 - exp(-(0.75E0 * {moved} + 0.25E0 * {now}) / 0.12E0), 0), 1) ELSE 0 END', 'output_drift')} FROM w"""
    )


def feature_drift(spark, d):
    return rounded(drift.feature_drift(adapters.experts(spark, d), FEATURES), ["game_id"], ["feature_drift"])


def _feature_sql():
    agg = ", ".join(
        f"{fn}(f{i}) OVER ({LW} ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING) AS {n}{i}"
        for i in range(3) for fn, n, lo, hi in (("avg", "mr", 12, 1), ("stddev_samp", "sr", 12, 1), ("avg", "mo", 96, 13), ("stddev_samp", "so", 96, 13))
    )
    raw = "(" + " + ".join(f"0.5E0 * abs(mr{i} - mo{i}) / GREATEST(so{i}, 1e-6) + 0.5E0 * abs(ln((sr{i} + 1e-6) / (so{i} + 1e-6)))" for i in range(3)) + ") / 3"
    return with_views(
        FEATURE_SQL + f", w AS (SELECT game_id, row_number() OVER ({LW}) - 1 AS n, {agg} FROM fx) SELECT game_id, {_r(f'CASE WHEN n >= 24 THEN 1 - exp(-({raw}) / 2) ELSE 0 END', 'feature_drift')} FROM w"
    )


def mmd_drift(spark, d):
    return rounded(drift.mmd_drift(adapters.experts(spark, d), FEATURES), ["game_id"], ["mmd_drift"])


def expert_decay_loss(spark, d):
    e = adapters.experts(spark, d).withColumn("expert_1", F.when(F.col("game_id") % 9 != 0, F.col("expert_1")))
    return rounded(drift.expert_losses(e, EXPERTS), ["game_id"], [f"{x}_{h}_loss" for x in EXPERTS for h in ("short", "long")])


def _decay_sql():
    ll = [f"CASE actual WHEN 0 THEN -ln(e{j}_0) WHEN 1 THEN -ln(e{j}_1) ELSE -ln(e{j}_2) END" for j in range(3)]
    ll[1] = f"CASE WHEN game_id % 9 <> 0 THEN {ll[1]} END"
    out = []
    for j in range(3):
        for h, w in (("short", 24), ("long", 96)):
            num = f"sum(l{j} * power(2, (i - {{0}}) / 24.0E0)) FILTER (WHERE i >= {{0}} - {w})"
            den = f"sum(CASE WHEN l{j} IS NOT NULL THEN power(2, (i - {{0}}) / 24.0E0) END) FILTER (WHERE i >= {{0}} - {w})"
            out.append(f"({num} / {den}) AS {h[0]}{j}".replace("{0}", "b.n"))
    final = ", ".join(_r(f"COALESCE({a}{j}, {b}{j})", f"expert_{j}_{h}_loss") for j in range(3) for h, a, b in (("short", "s", "l"), ("long", "l", "s")))
    return with_views(
        experts_sql() + f""", b AS (SELECT game_id, league, row_number() OVER ({LW}) AS n, {', '.join(f'{x} AS l{j}' for j, x in enumerate(ll))} FROM experts),
        j AS (SELECT b.game_id, {', '.join(out).replace('l0 *', 'h.l0 *').replace('l1 *', 'h.l1 *').replace('l2 *', 'h.l2 *').replace('WHEN l', 'WHEN h.l').replace('(i -', '(h.n -').replace('WHERE i', 'WHERE h.n')}
          FROM b LEFT JOIN b h ON h.league = b.league AND h.n BETWEEN b.n - 96 AND b.n - 1 GROUP BY b.game_id)
        SELECT game_id, {final} FROM j"""
    )


def conformal_sets(spark, d):
    e = adapters.experts(spark, d).withColumn("p", prob.normalise(F.array(*P3)))
    out = drift.conformal(e).withColumns({f"pv{i}": F.col("p_values")[i] for i in range(3)})
    return rounded(out, ["game_id", "set_size", "history_rows"], ["pv0", "pv1", "pv2", "top_gap", "entropy", "conformal_signal"])


def _conformal_sql():
    pv = ", ".join(f"(1 + len(list_filter(xs, lambda s: s >= 1 - p{i} - 1e-12))) / (len(xs) + 1.0E0) AS pv{i}" for i in range(3))
    gap = "list_reverse_sort([p0, p1, p2])[1] - list_reverse_sort([p0, p1, p2])[2]"
    return with_views(
        f""", n AS (SELECT *, {NORM} FROM predictions), s AS (SELECT *, 1 - CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS sc FROM n),
        h AS (SELECT *, COALESCE(list(sc) OVER ({LW} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING), []) AS xs FROM s), v AS (SELECT *, len(xs) >= 30 AS ok, {pv} FROM h),
        z AS (SELECT *, CAST((pv0 > 0.1)::INT + (pv1 > 0.1)::INT + (pv2 > 0.1)::INT AS BIGINT) AS sz FROM v)
        SELECT game_id, CASE WHEN ok THEN sz END AS set_size, CAST(len(xs) AS BIGINT) AS history_rows, {_r('CASE WHEN ok THEN pv0 END', 'pv0')}, {_r('CASE WHEN ok THEN pv1 END', 'pv1')}, {_r('CASE WHEN ok THEN pv2 END', 'pv2')},
          {_r(gap, 'top_gap')}, {_r('-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2))', 'entropy')},
          {_r(f'CASE WHEN ok THEN 0.6E0 * LEAST(GREATEST((sz - 1) / 2.0E0, 0), 1) + 0.4E0 * LEAST(GREATEST(1 - ({gap}) / 0.25E0, 0), 1) ELSE 0 END', 'conformal_signal')} FROM z"""
    )


def recency_weights(spark, d):
    return rounded(drift.recency_weights(adapters.matches(spark, d)), ["game_id"], ["weight"])


RECENCY_SQL = with_views(
    f"SELECT game_id, {_r('LEAST(GREATEST(power(2, -(row_number() OVER (PARTITION BY league ORDER BY datetime DESC, game_id DESC) - 1) / 1800.0E0), 0.2), 1)', 'weight')} FROM matches"
)


def chrono_split(spark, d):
    return drift.chrono_split(adapters.matches(spark, d)).select("game_id", "pos", "split")


SPLIT_SQL = with_views(
    f""", w AS (SELECT game_id, row_number() OVER ({LW}) AS pos, count(*) OVER (PARTITION BY league) AS n FROM matches)
    SELECT game_id, pos, CASE WHEN pos <= GREATEST(60, floor(n * 0.6E0)) THEN 'fit' WHEN pos <= GREATEST(90, floor(n * 0.75E0)) THEN 'tune' ELSE 'eval' END AS split FROM w"""
)


def drift_slices(spark, d):
    """Metric bundle of the rows whose output drift reaches the league median, and of the two late windows."""
    from matchloom.operators import reports

    e = drift.output_drift(adapters.experts(spark, d), EXPERTS).select(
        "league", "game_id", "datetime", "actual", F.array(*P3).alias("p"), F.round("output_drift", 9).alias("output_drift")
    )
    e = spool(e, "drift")  # read by the quantile, the slice and the windows
    high = reports.at_least_quantile(e, "output_drift", 0.5, ["league"]).withColumn("slice", F.lit("high_drift"))
    late = drift.late_windows(e).withColumnRenamed("window", "slice")
    out = reports.metric_bundle(high.unionByName(late), ["league", "slice"])
    return rounded(out, ["league", "slice", "rows"], ["accuracy", "logloss", "brier", "ece"], 5)


def _slices_sql():
    inner = _output_sql()
    head, tail = inner.rsplit("SELECT game_id, ROUND(", 1)
    r5 = ", ".join(_r(m, m, 5) for m in ("accuracy", "logloss", "brier", "ece"))
    od = "ROUND(" + tail
    od = od.replace(" + 1e-9, 6) AS output_drift", ", 9) AS od")
    expr, src = od.rsplit(" FROM w", 1)
    return head + f""", dr AS (SELECT w.*, {NORM}, {expr} FROM w), md AS (SELECT *, median(od) OVER (PARTITION BY league) AS m, count(*) OVER (PARTITION BY league) AS nn,
        row_number() OVER (PARTITION BY league ORDER BY datetime DESC, game_id DESC) - 1 AS back FROM dr),
      sl AS (SELECT *, 'high_drift' AS slice FROM md WHERE od >= m UNION ALL SELECT *, CASE WHEN back < GREATEST(50, nn // 4) THEN 'window_2' ELSE 'window_1' END FROM md WHERE back < 2 * GREATEST(50, nn // 4) AND nn >= 200),
      {bundle_sql('sl', 'league, slice')} SELECT league, slice, rows, {r5} FROM met"""


def _ratings_sql(names, columns, tail="", views=""):
    """The rating recursion game by game: a league's ratings travel as a list in the order of its teams."""
    rules = ", ".join(
        f"('{n}', {r.k}E0, {r.home}E0, {r.start}E0, {1.0 if r.keep is None else r.keep}E0, '{r.multiplier}')" for n, r in ((n, rating.RULES[n]) for n in names)
    )
    factor = (
        "CASE multiplier WHEN 'log_margin' THEN 1 + 0.35E0 * ln(1 + margin) WHEN 'margin_over_gap' THEN ln(1 + greatest(1, margin)) * 2.2E0 / (0.001E0 * abs(gap) + 2.2E0) ELSE 1 END"
    )
    won = "CASE WHEN home_score > away_score THEN 1E0 WHEN home_score = away_score AND multiplier <> 'margin_over_gap' THEN 0.5E0 ELSE 0E0 END"
    return with_views(f"""{views}, rules(rule, k, side, start, keep, multiplier) AS MATERIALIZED (VALUES {rules}),
      teams AS (SELECT league, team, row_number() OVER (PARTITION BY league ORDER BY team) AS place FROM (SELECT league, home AS team FROM matches UNION SELECT league, away FROM matches)),
      games AS MATERIALIZED (SELECT m.*, h.place AS hp, a.place AS ap, row_number() OVER (PARTITION BY m.league ORDER BY datetime, game_id) AS n,
          dense_rank() OVER (PARTITION BY m.league ORDER BY year(datetime)) AS season, CAST(abs(home_score - away_score) AS DOUBLE) AS margin
        FROM matches m JOIN teams h ON h.league = m.league AND h.team = home JOIN teams a ON a.league = m.league AND a.team = away),
      run(rule, league, n, season, game_id, elo_home, elo_away, elo_expected, ratings) AS (
        SELECT rule, league, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS BIGINT), 0E0, 0E0, 0E0, list(start ORDER BY place) FROM teams, rules GROUP BY rule, league
        UNION ALL
        SELECT rule, league, n, season, game_id, elo_home, elo_away, elo_expected,
          CASE WHEN training_included THEN list_transform(held, lambda x, i: x + CASE i WHEN hp THEN change WHEN ap THEN -change ELSE 0E0 END) ELSE held END
        FROM (SELECT *, k * {factor} * ({won} - elo_expected) AS change
          FROM (SELECT *, 1 / (1 + power(10E0, -gap / 400)) AS elo_expected
            FROM (SELECT *, held[hp] AS elo_home, held[ap] AS elo_away, held[hp] + side - held[ap] AS gap
              FROM (SELECT rule, league, g.n, g.season, g.game_id, hp, ap, margin, home_score, away_score, training_included, k, side, multiplier,
                  CASE WHEN g.season > r.season THEN list_transform(ratings, lambda x: start + keep * (x - start)) ELSE ratings END AS held
                FROM run r JOIN games g USING (league) JOIN rules USING (rule) WHERE g.n = r.n + 1)))))
      SELECT {columns} FROM run {tail or "WHERE n > 0"}""").replace("WITH ", "WITH RECURSIVE ", 1)


RATED = ", ".join(_r(c, c) for c in ("elo_home", "elo_away", "elo_expected"))


def elo_main(spark, d):
    """Sequential rating per league; checked against a plain loop in the tests."""
    return rounded(rating.ratings(adapters.matches(spark, d)), ["league", "game_id"], ["elo_home", "elo_away", "elo_expected"])


def elo_variants(spark, d):
    out = rating.sweep(adapters.matches(spark, d), {n: rating.RULES[n] for n in ("margin", "three_way", "baseline")})
    return rounded(out, ["league", "game_id", "rule"], ["elo_home", "elo_away", "elo_expected"])


def elo_report(spark, d):
    """Rating accuracy against the home-win base rate per league and rule."""
    from matchloom.operators import reports

    g = adapters.matches(spark, d)
    out = rating.sweep(g, {n: rating.RULES[n] for n in ("main", "baseline")})
    joined = out.join(g.select("game_id", "home_score", "away_score"), "game_id")
    rep = reports.base_rate(joined, F.col("home_score") > F.col("away_score"), F.col("elo_expected"), ["league", "rule"])
    return rounded(rep, ["league", "rule", "samples"], ["accuracy", "base_rate", "improvement"])


def league_bundle(spark, d):
    """Season and league outputs together: rating accuracy, top-4 hits, Low/High accuracy."""
    from matchloom.operators import reports

    g = adapters.matches(spark, d)
    scored = reports.with_scores(adapters.predictions(spark, d)).select("game_id", "datetime", "actual", "top4_hit", "high", "actual_high")
    both = rating.ratings(g).join(scored, "game_id").withColumn("season", F.year("datetime"))
    out = both.groupBy("season", "league").agg(
        F.count(F.lit(1)).alias("games"), F.avg(((F.col("elo_expected") >= 0.5) == (F.col("actual") == 0)).cast("double")).alias("elo_accuracy"),
        F.avg("top4_hit").alias("top4_rate"), F.avg(((F.col("high") >= 0.5).cast("double") == F.col("actual_high")).cast("double")).alias("low_high_accuracy"),
    )
    return rounded(out, ["season", "league", "games"], ["elo_accuracy", "top4_rate", "low_high_accuracy"])


def _report_sql():
    hit = "CAST((elo_expected > 0.5E0) = (home_score > away_score) AS DOUBLE)"
    base = "avg(CAST(home_score > away_score AS DOUBLE))"
    return _ratings_sql(
        ["main", "baseline"],
        f"run.league, rule, count(*) AS samples, {_r(f'avg({hit})', 'accuracy')}, {_r(base, 'base_rate')}, {_r(f'avg({hit}) - {base}', 'improvement')}",
        "JOIN matches USING (game_id) WHERE n > 0 GROUP BY run.league, rule",
    )


def _bundle_sql():
    calls = {
        "elo_accuracy": "avg(CAST((elo_expected >= 0.5E0) = (actual = 0) AS DOUBLE))", "top4_rate": "avg(top4_hit)",
        "low_high_accuracy": "avg(CAST(CAST(high >= 0.5E0 AS DOUBLE) = actual_high AS DOUBLE))",
    }
    return _ratings_sql(
        ["main"], f"year(datetime) AS season, run.league, count(*) AS games, {', '.join(_r(x, n) for n, x in calls.items())}",
        "JOIN scored USING (game_id) WHERE n > 0 GROUP BY year(datetime), run.league", SCORED_SQL,
    )


def routing_replay(spark, d):
    out = routing.replay(adapters.experts(spark, d), EXPERTS, features=FEATURES)
    flat = out.withColumns({f"routed_{i}": F.col("routed")[i] for i in range(3)} | {f"weight_{i}": F.col("weights")[i] for i in range(3)})
    return rounded(flat, ["league", "game_id"], [f"routed_{i}" for i in range(3)] + [f"weight_{i}" for i in range(3)] + ["drift", "uncertainty", "temperature"])


def routing_gate(spark, d):
    e = adapters.experts(spark, d).withColumn("p", F.array(*P3))
    routed = spool(routing.replay(e, EXPERTS).select(*routing.REPORTED), "replay")
    return routing.acceptance_gate(routing.replay_report(e, routed))


QUERIES = {
    "output_drift": output_drift, "feature_drift": feature_drift, "mmd_drift": mmd_drift, "expert_decay_loss": expert_decay_loss, "conformal_sets": conformal_sets,
    "recency_weights": recency_weights, "chrono_split": chrono_split, "drift_slices": drift_slices, "elo_main": elo_main, "elo_variants": elo_variants,
    "elo_report": elo_report, "league_bundle": league_bundle, "routing_replay": routing_replay, "routing_gate": routing_gate,
}
ORACLES = {
    "output_drift": _output_sql(), "feature_drift": _feature_sql(), "expert_decay_loss": _decay_sql(), "conformal_sets": _conformal_sql(), "recency_weights": RECENCY_SQL,
    "chrono_split": SPLIT_SQL, "drift_slices": _slices_sql(), "elo_main": _ratings_sql(["main"], f"league, game_id, {RATED}"),
    "elo_variants": _ratings_sql(["margin", "three_way", "baseline"], f"league, game_id, rule, {RATED}"), "elo_report": _report_sql(), "league_bundle": _bundle_sql(),
}
