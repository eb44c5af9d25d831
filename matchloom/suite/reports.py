"""Registered report queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import prob
from matchloom.operators import harmonise, reports
from matchloom.sources import adapters
from matchloom.sources.adapters import with_views
from matchloom.suite.history import _r, rounded

# ---- SQL building blocks -----------------------------------------------------------------------


def pois(k: int, lam: str) -> str:
    import math

    return f"exp(-({lam}) + {k}.0E0 * ln({lam}) - {math.lgamma(k + 1.0)!r}::DOUBLE)"


def cdf(lam: str, upto: int) -> str:
    return "(" + " + ".join(pois(k, lam) for k in range(upto + 1)) + ")"


P3 = ("pred_home", "pred_draw", "pred_away")
S = "(pred_home + pred_draw + pred_away)"
NORM = ", ".join(f"{c} / {S} AS {n}" for c, n in zip(P3, ("p0", "p1", "p2")))
PICK = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
PY = "CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
BR = " + ".join(f"power(p{i} - CASE WHEN actual = {i} THEN 1 ELSE 0 END, 2)" for i in range(3))

CELLS_SQL = f"""
grid AS (SELECT h, a FROM range(7) t(h), range(7) u(a)),
lams AS (SELECT DISTINCT lambda_home AS lh, lambda_away AS la FROM predictions),
pm AS (SELECT lam, k, exp(-lam + k * ln(lam) - lgamma(k + 1)) AS p
       FROM (SELECT lh AS lam FROM lams UNION SELECT la FROM lams), range(7) t(k)),
cells AS (SELECT lh, la, h, a, x.p * y.p AS p, 0 AS o FROM lams, grid, pm x, pm y WHERE x.lam = lh AND x.k = h AND y.lam = la AND y.k = a),
every AS (SELECT * FROM cells UNION ALL SELECT lh, la, 999, 999, GREATEST(1 - sum(p), 0), 1 FROM cells GROUP BY lh, la),
ranked AS (SELECT *, CASE WHEN o = 1 THEN 'OTHER' ELSE h || '-' || a END AS label,
           row_number() OVER (PARTITION BY lh, la ORDER BY round(p, 12) DESC, o, h, a) AS rn FROM every),
top4 AS (SELECT lh, la, label, p, rn FROM ranked WHERE rn <= 4)
"""
SCORED_SQL = f""", {CELLS_SQL},
n AS (SELECT *, {NORM} FROM predictions),
scored AS (SELECT n.*, CASE WHEN {PICK} = actual THEN 1.0E0 ELSE 0 END AS correct, -ln({PY}) AS logloss, {BR} AS brier,
   1 - {cdf('lambda_home + lambda_away', 6)} AS high,
   CASE WHEN actual_home_score + actual_away_score >= 7 THEN 1.0E0 ELSE 0 END AS actual_high,
   CASE WHEN EXISTS (SELECT 1 FROM top4 t WHERE t.lh = lambda_home AND t.la = lambda_away AND t.label =
      CASE WHEN actual_home_score >= 7 OR actual_away_score >= 7 THEN 'OTHER' ELSE actual_home_score || '-' || actual_away_score END)
     THEN 1.0E0 ELSE 0 END AS top4_hit FROM n)
"""
SUMMARY_SQL = ", ".join(
    _r(e, n) for n, e in {
        "accuracy": "avg(correct)", "logloss": "avg(logloss)", "brier": "avg(brier)",
        "score_mae": "avg((abs(actual_home_score - lambda_home) + abs(actual_away_score - lambda_away)) / 2)",
        "high_rate": "avg(actual_high)", "low_high_accuracy": "avg(CASE WHEN (high >= 0.5) = (actual_high = 1) THEN 1 ELSE 0 END)",
        "top4_rate": "avg(top4_hit)",
    }.items()
)
EDGE_SQL = "(" + " + ".join(f"CASE WHEN conf >= {i * 0.1!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(10)) + " - 1)"
SUMMARY = ["accuracy", "logloss", "brier", "score_mae", "high_rate", "low_high_accuracy", "top4_rate"]


def _scored(spark, d):
    return reports.with_scores(adapters.predictions(spark, d))


def oos_summary(spark, d):
    return rounded(reports.summarise(_scored(spark, d), ["league"]), ["league", "predictions"], SUMMARY)


def leaderboard(spark, d):
    return rounded(reports.leaderboard(_scored(spark, d)), ["model", "rank", "predictions"], ["accuracy", "logloss", "brier"])


def category_metrics(spark, d):
    return rounded(reports.summarise(_scored(spark, d), ["game_category"]), ["game_category", "predictions"], SUMMARY)


def calibration_bins(spark, d):
    df = reports.calibration_table(adapters.predictions(spark, d), "pred_home", F.col("actual") == 0)
    return rounded(df, ["bin", "rows"], ["mean_p", "rate"])


def _calibration_sql():
    e = " + ".join(f"CASE WHEN pred_home > {i / 10!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))
    return with_views(
        f""", b AS (SELECT {e} AS bin, pred_home AS p, CASE WHEN actual = 0 THEN 1.0E0 ELSE 0 END AS y FROM predictions)
        SELECT CAST(r.range AS BIGINT) AS bin, CAST(count(p) AS BIGINT) AS rows, {_r('avg(p)', 'mean_p')}, {_r('avg(y)', 'rate')}
        FROM range(10) r LEFT JOIN b ON b.bin = r.range GROUP BY 1"""
    )


def auc_rank(spark, d):
    df = reports.auc(adapters.predictions(spark, d), "pred_home", F.col("actual") == 0, ["league"])
    return rounded(df, ["league", "positives", "negatives"], ["auc"])


AUC_SQL = with_views(
    f""", r AS (SELECT league, actual = 0 AS pos, rank() OVER w + (count(*) OVER (PARTITION BY league, pred_home) - 1) / 2.0E0 AS rk
       FROM predictions WINDOW w AS (PARTITION BY league ORDER BY pred_home)),
    g AS (SELECT league, count(*) FILTER (WHERE pos) AS positives, count(*) FILTER (WHERE NOT pos) AS negatives, sum(rk) FILTER (WHERE pos) AS s FROM r GROUP BY league)
    SELECT league, positives, negatives, {_r('(s - positives * (positives + 1) / 2.0E0) / (positives * negatives)', 'auc')} FROM g"""
)


def basic_metrics(spark, d):
    from matchloom.functions import score

    df = adapters.predictions(spark, d)
    y = (F.col("actual") == 0).cast("double")
    terms = score.binary_terms(F.col("pred_home"), y) | score.error_terms(F.col("lambda_home"), F.col("actual_home_score"))
    return rounded(df.groupBy("league").agg(*[c.alias(n) for n, c in terms.items()]), ["league"], list(terms))


BASIC_SQL = with_views(
    f""", b AS (SELECT *, CASE WHEN actual = 0 THEN 1.0E0 ELSE 0 END AS y FROM predictions)
    SELECT league, {_r('avg(CASE WHEN (pred_home >= 0.5) = (y = 1) THEN 1 ELSE 0 END)', 'accuracy')}, {_r('avg(power(pred_home - y, 2))', 'brier')},
      {_r('avg(-(y * ln(pred_home) + (1 - y) * ln(1 - pred_home)))', 'logloss')}, {_r('avg(abs(lambda_home - actual_home_score))', 'mae')},
      {_r('sqrt(avg(power(lambda_home - actual_home_score, 2)))', 'rmse')},
      {_r('avg(CASE WHEN round(lambda_home) = actual_home_score THEN 1 ELSE 0 END)', 'exact')} FROM b GROUP BY league"""
)


def ece_bundle(spark, d):
    df = reports.metric_bundle(reports.vector_of(adapters.predictions(spark, d)), ["league", "model"])
    return rounded(df, ["league", "model", "rows"], ["accuracy", "logloss", "brier", "ece"])


def bundle_sql(source: str, keys: str, tail: str = "") -> str:
    """SQL of the metric bundle over p0, p1, p2 and actual."""
    return (
        f"mx AS (SELECT *, GREATEST(p0, p1, p2) AS conf, CASE WHEN {PICK} = actual THEN 1.0E0 ELSE 0 END AS hit, -ln(GREATEST({PY}, 1e-12)) AS ll, {BR} AS br FROM {source}),"
        f" bn AS (SELECT {keys}, {EDGE_SQL} AS b, count(*) AS n, sum(hit) AS h, sum(conf) AS c, sum(ll) AS l, sum(br) AS r FROM mx GROUP BY {keys}, b),"
        f" met AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS rows, sum(h) / sum(n) AS accuracy, sum(l) / sum(n) AS logloss, sum(r) / sum(n) AS brier, sum(abs(h - c)) / sum(n) AS ece FROM bn GROUP BY {keys}){tail}"
    )


MET = ", ".join(_r(m, m) for m in ("accuracy", "logloss", "brier", "ece"))


def condition_accuracy(spark, d):
    scored = _scored(spark, d).withColumn("venue_known", F.when(F.col("venue") != "V0", F.col("venue")))
    df = reports.condition_accuracy(scored, ["league", "game_category", "venue_known", "home"])
    return rounded(df, ["condition", "value", "samples"], ["accuracy"])


def condition_cube(spark, d):
    df = reports.condition_cube(_scored(spark, d), "league", "game_category")
    return rounded(df, ["league", "game_category", "samples"], ["accuracy"])


N_SQL = f", n AS (SELECT *, {NORM} FROM predictions), scored AS (SELECT *, CASE WHEN {PICK} = actual THEN 1.0E0 ELSE 0 END AS correct FROM n)"
CONDITION_SQL = with_views(
    N_SQL + ", u AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS condition, {e} AS value, correct FROM scored"
        for c, e in (("league", "league"), ("game_category", "game_category"), ("venue_known", "CASE WHEN venue <> 'V0' THEN venue ELSE 'unknown' END"), ("home", "home"))
    ) + f") SELECT condition, value, count(*) AS samples, {_r('avg(correct)', 'accuracy')} FROM u GROUP BY 1, 2"
)


def competition_counts(spark, d):
    g = harmonise.classify(_typed_games(spark, d))
    return g.groupBy("league").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("category").isin("climax", "japan_series")).alias("postseason"),
        F.count_if(F.col("category") == "unknown").alias("unclassified"), F.count_if("training_default").alias("training"),
    )


TYPES = {"1-URGENT": "Regular  Season", "2-HIGH": "セ・パ交流戦", "3-MEDIUM": "クライマックスシリーズ 第1戦", "4-NOT SPECIFIED": "オープン戦", "5-LOW": "misc"}
TYPE_CATEGORY = {"1-URGENT": "regular", "2-HIGH": "interleague", "3-MEDIUM": "climax", "4-NOT SPECIFIED": "excluded", "5-LOW": "unknown"}


def _typed_games(spark, d):
    orders = adapters.table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    label = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    typed = orders.select(F.col("o_orderkey").alias("game_id"), F.try_element_at(label, F.col("o_orderpriority")).alias("game_type"))
    return adapters.matches(spark, d).join(typed, "game_id")


TYPED_SQL = (
    ", typed AS (SELECT m.*, CASE o.o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_CATEGORY.items())
    + " ELSE 'unknown' END AS category FROM matches m JOIN orders o ON o.o_orderkey = m.game_id)"
)
COMPETITION_SQL = with_views(
    TYPED_SQL + """ SELECT league, count(*) AS games, count(*) FILTER (WHERE category IN ('climax', 'japan_series')) AS postseason,
    count(*) FILTER (WHERE category = 'unknown') AS unclassified, count(*) FILTER (WHERE category IN ('regular', 'interleague')) AS training FROM typed GROUP BY league"""
)


def _starters(spark, d):
    key = F.col("game_id")
    return adapters.matches(spark, d).withColumns(
        {
            "home_starter": F.when((key % 7 == 0) & (F.year("datetime") < 1998), "").otherwise(F.concat(F.lit("P"), key.cast("string"))),
            "away_starter": F.when(key % 11 == 0, "nan").otherwise(F.concat(F.lit("Q"), key.cast("string"))),
        }
    )


def coverage_gate(spark, d):
    df = reports.coverage_gate(_starters(spark, d), F.year("datetime"), "home_starter", "away_starter", 90.0, 1996)
    return rounded(df, ["season", "games", "both_starters", "status"], ["coverage_pct"])


COVERAGE_SQL = with_views(
    f""", c AS (SELECT CAST(year(datetime) AS BIGINT) AS season, count(*) AS games,
      count(*) FILTER (WHERE NOT (game_id % 7 = 0 AND year(datetime) < 1998) AND game_id % 11 <> 0) AS both_starters FROM matches GROUP BY 1)
    SELECT season, games, both_starters, CASE WHEN season < 1996 THEN 'REFERENCE_ONLY' WHEN both_starters / games * 100 >= 90 THEN 'PASS' ELSE 'FAIL' END AS status,
      {_r('both_starters / games * 100', 'coverage_pct')} FROM c"""
)


def season_status(spark, d):
    return reports.season_status(adapters.matches(spark, d), F.year("datetime"), F.col("game_id") % 400 != 3)


SEASON_SQL = with_views(
    """SELECT CAST(year(datetime) AS BIGINT) AS season, count(*) AS games, count(*) FILTER (WHERE game_id % 400 <> 3) AS complete_games,
    bool_and(game_id % 400 <> 3) AS all_complete FROM matches GROUP BY GROUPING SETS ((1), ())"""
)


def quality_profile(spark, d):
    df = adapters.table(spark, d, "lineitem")
    return reports.quality_profile(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"])


def _quality_sql():
    cols = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    nums = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    q = " UNION ALL ".join(
        f"""SELECT CASE WHEN max(n) >= 20 AND max(q3 - q1) > 0 AND count(*) FILTER (WHERE v < q1 - 5 * (q3 - q1) OR v > q3 + 5 * (q3 - q1)) / max(n) > 0.1 THEN 1 ELSE 0 END AS f
        FROM (SELECT v, n, max(CASE WHEN rn = n // 4 + 1 THEN v END) OVER () AS q1, max(CASE WHEN rn = 3 * n // 4 + 1 THEN v END) OVER () AS q3
              FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM lineitem))""" for c in nums
    )
    miss = " + ".join(f"CASE WHEN avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 0.2 THEN 1 ELSE 0 END" for c in cols)
    return f"""WITH s AS (SELECT count(*) AS rows, CAST({miss} AS BIGINT) AS sparse_columns FROM lineitem),
    dd AS (SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(cols)})),
    o AS (SELECT CAST(sum(f) AS BIGINT) AS outlier_columns FROM ({q}))
    SELECT rows, duplicates, sparse_columns, outlier_columns, CASE WHEN duplicates > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM s, dd, o"""


def probability_integrity(spark, d):
    k = F.col("game_id")
    df = adapters.predictions(spark, d).withColumns(
        {
            "pred_draw": F.when(k % 500 == 7, None).when(k % 500 == 9, -0.1).otherwise(F.col("pred_draw")),
            "pred_away": F.when(k % 500 == 11, F.col("pred_away") + 0.01).otherwise(F.col("pred_away")),
        }
    )
    return reports.probability_integrity(df, ["pred_home", "pred_draw", "pred_away"], "game_id")


INTEGRITY_SQL = with_views(
    """, c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE game_id % 500 = 7) AS missing, count(*) FILTER (WHERE game_id % 500 = 9) AS outside,
    count(*) FILTER (WHERE game_id % 500 IN (9, 11)) AS mass FROM predictions)
    SELECT *, CAST(0 AS BIGINT) AS repeated, CASE WHEN missing + outside + mass > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c"""
)


def state_kind_pivot(spark, d):
    obs = adapters.observations(spark, d).filter(harmonise.pit_usable(F.col("available_at"), F.col("prediction_time")))
    states = reports.zero_filled_pivot(obs, "game_id", "state", ["VERIFIED", "PROJECTED", "STALE", "CONFLICT", "UNKNOWN"])
    kinds = reports.zero_filled_pivot(obs, "game_id", "kind", ["STARTER", "LINEUP", "INJURY", "AVAILABILITY", "REST_TRAVEL", "WEATHER", "MARKET", "BULLPEN"])
    return states.join(kinds, "game_id")


def _pivot_sql():
    cols = [f"count(*) FILTER (WHERE state = '{s}') AS {s.lower()}" for s in ("VERIFIED", "PROJECTED", "STALE", "CONFLICT", "UNKNOWN")]
    cols += [f"count(*) FILTER (WHERE kind = '{k}') AS {k.lower()}" for k in "STARTER LINEUP INJURY AVAILABILITY REST_TRAVEL WEATHER MARKET BULLPEN".split()]
    return with_views(f"SELECT game_id, {', '.join(cols)} FROM observations WHERE available_at <= prediction_time GROUP BY game_id")


def pit_counters(spark, d):
    ok = harmonise.pit_usable(F.col("available_at"), F.col("prediction_time"), F.col("state"))
    return adapters.observations(spark, d).groupBy("kind").agg(F.count_if(ok).alias("used"), F.count_if(~ok).alias("rejected"))


PIT_COUNTERS_SQL = with_views(
    """, o AS (SELECT kind, available_at <= prediction_time AND state IN ('VERIFIED', 'PROJECTED') AS ok FROM observations)
    SELECT kind, count(*) FILTER (WHERE ok) AS used, count(*) FILTER (WHERE NOT ok) AS rejected FROM o GROUP BY kind"""
)


def base_rate(spark, d):
    p = adapters.predictions(spark, d)
    df = reports.base_rate(p, F.col("actual") == 0, F.col("pred_home"), ["league"])
    return rounded(df, ["league", "samples"], ["accuracy", "base_rate", "improvement"])


BASE_SQL = with_views(
    f""", b AS (SELECT league, CASE WHEN (pred_home > 0.5) = (actual = 0) THEN 1.0E0 ELSE 0 END AS hit, CASE WHEN actual = 0 THEN 1.0E0 ELSE 0 END AS y FROM predictions)
    SELECT league, count(*) AS samples, {_r('avg(hit)', 'accuracy')}, {_r('avg(y)', 'base_rate')}, {_r('avg(hit) - avg(y)', 'improvement')} FROM b GROUP BY league"""
)


def high_confidence(spark, d):
    df = reports.vector_of(adapters.predictions(spark, d)).withColumn("p", prob.normalise(F.col("p")))
    return rounded(reports.high_confidence_error(df, "p", "actual", ["league"], 0.60), ["league", "sure_rows"], ["error_rate"])


HIGH_SQL = with_views(
    N_SQL + f" SELECT league, count(*) FILTER (WHERE GREATEST(p0, p1, p2) >= 0.6) AS sure_rows, {_r('avg(1 - correct) FILTER (WHERE GREATEST(p0, p1, p2) >= 0.6)', 'error_rate')} FROM scored GROUP BY league"
)


def dispersion(spark, d):
    df = reports.dispersion(adapters.predictions(spark, d), "actual_home_score", ["league", "model"])
    return rounded(df, ["league", "model", "n"], ["mu", "alpha", "size"])


DISPERSION_SQL = with_views(
    f""", g AS (SELECT league, model, count(*) AS n, avg(actual_home_score) AS mu, var_pop(actual_home_score) AS vp, var_samp(actual_home_score) AS vs FROM predictions GROUP BY 1, 2)
    SELECT league, model, n, {_r('mu', 'mu')}, {_r('GREATEST((vp - mu) / GREATEST(mu * mu, 0.25), 0.03)', 'alpha')},
      {_r('CASE WHEN n < 8 OR vs - mu <= 1e-9 THEN 1e6 ELSE LEAST(GREATEST(mu * mu / (vs - mu), 0.25), 1e6) END', 'size')} FROM g"""
)


def shared_lambda(spark, d):
    p = adapters.predictions(spark, d).withColumnsRenamed({"actual_home_score": "home_score", "actual_away_score": "away_score"})
    return rounded(reports.shared_component(p, ["league"]), ["league"], ["shared"])


SHARED_SQL = with_views(
    f"""SELECT league, {_r('LEAST(GREATEST(covar_pop(actual_home_score - lambda_home, actual_away_score - lambda_away), 0), GREATEST(LEAST(median(lambda_home), median(lambda_away)) * 0.85, 0))', 'shared')}
    FROM predictions GROUP BY league"""
)


def low_high_confusion(spark, d):
    df = reports.confusion(_scored(spark, d))
    return rounded(df, ["high_tp", "high_fp", "high_fn"], ["high_accuracy", "low_accuracy", "home_mae", "away_mae", "total_mae"])


CONFUSION_SQL = with_views(
    f""", c AS (SELECT *, 1 - {cdf('lambda_home + lambda_away', 6)} >= 0.5 AS call, actual_home_score >= 7 OR actual_away_score >= 7 AS hi FROM predictions)
    SELECT count(*) FILTER (WHERE call AND hi) AS high_tp, count(*) FILTER (WHERE call AND NOT hi) AS high_fp, count(*) FILTER (WHERE NOT call AND hi) AS high_fn,
      {_r('count(*) FILTER (WHERE call AND hi) / GREATEST(count(*) FILTER (WHERE hi), 1)', 'high_accuracy')},
      {_r('count(*) FILTER (WHERE NOT call AND NOT hi) / GREATEST(count(*) FILTER (WHERE NOT hi), 1)', 'low_accuracy')},
      {_r('avg(abs(actual_home_score - lambda_home))', 'home_mae')}, {_r('avg(abs(actual_away_score - lambda_away))', 'away_mae')},
      {_r('avg(abs(actual_home_score + actual_away_score - lambda_home - lambda_away))', 'total_mae')} FROM c"""
)


def weakness_priorities(spark, d):
    df = reports.weaknesses(reports.summarise(_scored(spark, d), ["league"]))
    return rounded(df, ["league", "objective"], ["priority"])


WEAKNESS_SQL = with_views(
    SCORED_SQL + """, s AS (SELECT league, avg(correct) AS acc, avg(logloss) AS ll, avg(brier) AS br, avg((abs(actual_home_score - lambda_home) + abs(actual_away_score - lambda_away)) / 2) AS mae,
      avg(CASE WHEN (high >= 0.5) = (actual_high = 1) THEN 1 ELSE 0 END) AS lh FROM scored GROUP BY league),
    u AS (SELECT league, 'win' AS objective, GREATEST(0.65 - acc, 0) + GREATEST(ll - 0.67, 0) AS x FROM s UNION ALL SELECT league, 'score', GREATEST(mae - 2, 0) * 0.35 FROM s
      UNION ALL SELECT league, 'low_high', GREATEST(0.68 - lh, 0) FROM s UNION ALL SELECT league, 'calibration', GREATEST(br - 0.25, 0) FROM s)
    SELECT league, objective, ROUND(CAST(x AS DOUBLE) + 1e-9, 6) AS priority FROM u ORDER BY x DESC, league, objective LIMIT 20"""
)


def segment_counts(spark, d):
    return adapters.predictions(spark, d).groupBy("league").agg(
        F.count_distinct("home").alias("home_teams"), F.count_distinct("away").alias("away_teams"), F.count_distinct("model").alias("models")
    )


SEGMENT_SQL = with_views(
    "SELECT league, count(DISTINCT home) AS home_teams, count(DISTINCT away) AS away_teams, count(DISTINCT model) AS models FROM predictions GROUP BY league"
)


def status_rollup(spark, d):
    gate = reports.coverage_gate(_starters(spark, d), F.year("datetime"), "home_starter", "away_starter", 90.0, 1996)
    return reports.status_rollup(gate)


ROLLUP_SQL = with_views(
    """, c AS (SELECT year(datetime) AS season, count(*) AS g, count(*) FILTER (WHERE NOT (game_id % 7 = 0 AND year(datetime) < 1998) AND game_id % 11 <> 0) AS b FROM matches GROUP BY 1),
    s AS (SELECT count(*) AS parts, count(*) FILTER (WHERE season >= 1996 AND b / g * 100 >= 90) AS passed FROM c)
    SELECT parts, passed, CASE WHEN passed = parts THEN 'PASS' WHEN passed > 0 THEN 'PARTIAL' ELSE 'DEFERRED' END AS status FROM s"""
)


def category_ablation(spark, d):
    """Summary of each training-set variant against the default set."""
    scored = _scored(spark, d)
    variants = {"base": ("regular", "interleague"), "regular_only": ("regular",), "all_classes": ("regular", "interleague", "special")}
    member = F.array_compact(F.array(*[F.when(F.col("game_category").isin(*cs), F.lit(v)) for v, cs in variants.items()]))
    summary = reports.summarise(scored.withColumn("variant", F.explode(member)), ["variant"])
    from matchloom.operators.joins import versus_baseline

    df = versus_baseline(summary, "variant", "base", ["accuracy", "logloss", "brier"])
    return rounded(df, ["variant"], ["accuracy", "logloss", "brier", "delta_accuracy", "delta_logloss", "delta_brier"])


ABLATION_SQL = with_views(
    SCORED_SQL + """, v AS (SELECT 'base' AS variant, * FROM scored WHERE game_category IN ('regular', 'interleague') UNION ALL SELECT 'regular_only', * FROM scored WHERE game_category = 'regular'
      UNION ALL SELECT 'all_classes', * FROM scored), s AS (SELECT variant, avg(correct) AS a, avg(logloss) AS l, avg(brier) AS b FROM v GROUP BY 1)
    SELECT s.variant, """ + ", ".join([_r("s.a", "accuracy"), _r("s.l", "logloss"), _r("s.b", "brier"), _r("s.a - z.a", "delta_accuracy"), _r("s.l - z.l", "delta_logloss"), _r("s.b - z.b", "delta_brier")])
    + " FROM s, (SELECT * FROM s WHERE variant = 'base') z"
)

# ---- event rows ---------------------------------------------------------------------------------

FLAG_TYPES = {"A": "公式戦", "N": "交流戦", "R": "オープン戦"}


def _event_rows(spark, d):
    li = adapters.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    stated = F.col("l_discount") > 0.05
    order = (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("game_id"), order.alias("row_order"),
        F.concat(F.lit("T"), (F.col("l_orderkey") % 30).cast("string")).alias("home"),
        F.concat(F.lit("T"), ((F.col("l_orderkey") + 7) % 30).cast("string")).alias("away"),
        F.col("l_shipdate").alias("date"),
        F.when(stated, F.col("l_partkey") % 10).alias("home_score"), F.when(stated, F.col("l_suppkey") % 9).alias("away_score"),
        F.when(F.col("l_linestatus") == "O", "top").otherwise("bottom").alias("half"),
        F.col("l_linenumber").cast("string").alias("inning"),
        (F.floor("l_quantity").cast("long") % 4 - 1).cast("string").alias("added_runs"),
        F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))).alias("home_pitcher"),
        F.when(F.col("l_suppkey") % 3 == 0, "nan").otherwise(F.concat(F.lit("Q"), F.col("l_suppkey").cast("string"))).alias("away_pitcher"),
        F.when(F.col("l_returnflag") == "A", FLAG_TYPES["A"]).when(F.col("l_returnflag") == "N", FLAG_TYPES["N"]).otherwise(
            F.when(F.col("l_partkey") % 5 == 0, FLAG_TYPES["R"])).alias("game_type"),
    )


EVENTS_SQL = """WITH ev AS (SELECT l_orderkey AS game_id, (l_linenumber::BIGINT * 100000000 + l_partkey) * 100000 + l_suppkey AS row_order,
  'T' || (l_orderkey % 30) AS home, 'T' || ((l_orderkey + 7) % 30) AS away, CASE WHEN l_discount > 0.05 THEN l_partkey % 10 END AS hs,
  CASE WHEN l_discount > 0.05 THEN l_suppkey % 9 END AS vs, l_linestatus = 'O' AS top, floor(l_quantity)::BIGINT % 4 - 1 AS runs,
  CASE WHEN l_suppkey % 4 <> 0 THEN 'P' || l_suppkey END AS hp, CASE WHEN l_suppkey % 3 <> 0 THEN 'Q' || l_suppkey END AS ap,
  CASE l_returnflag WHEN 'A' THEN 'regular' WHEN 'N' THEN 'interleague' ELSE CASE WHEN l_partkey % 5 = 0 THEN 'excluded' END END AS cls FROM lineitem)
"""


def game_aggregate(spark, d):
    games = reports.aggregate_games(_event_rows(spark, d), harmonise.classify)
    cols = ["game_id", "home", "away", "home_starter", "away_starter", "confirmed_starters", "category"]
    return rounded(games, cols, ["home_score", "away_score"])


GAME_SQL = EVENTS_SQL + """, g AS (SELECT game_id, arg_min(home, row_order) AS home, arg_min(away, row_order) AS away, arg_min(hp, row_order) FILTER (WHERE hp IS NOT NULL) AS home_starter,
   arg_min(ap, row_order) FILTER (WHERE ap IS NOT NULL) AS away_starter, arg_max(hs, row_order) FILTER (WHERE hs IS NOT NULL) AS hs, arg_max(vs, row_order) FILTER (WHERE vs IS NOT NULL) AS vs,
   COALESCE(sum(GREATEST(runs, 0)) FILTER (WHERE NOT top), 0) AS rh, COALESCE(sum(GREATEST(runs, 0)) FILTER (WHERE top), 0) AS ra,
   bool_or(cls = 'excluded') AS ex, bool_or(cls = 'interleague') AS il, bool_or(cls = 'regular') AS rg FROM ev GROUP BY game_id)
  SELECT game_id, home, away, home_starter, away_starter, home_starter IS NOT NULL AND away_starter IS NOT NULL AS confirmed_starters,
    CASE WHEN COALESCE(il, false) THEN 'interleague' WHEN COALESCE(rg, false) THEN 'regular' ELSE 'unknown' END AS category,
    CAST(CASE WHEN hs IS NOT NULL AND vs IS NOT NULL THEN hs ELSE rh END AS DOUBLE) AS home_score, CAST(CASE WHEN hs IS NOT NULL AND vs IS NOT NULL THEN vs ELSE ra END AS DOUBLE) AS away_score
  FROM g WHERE NOT COALESCE(ex, false)"""


def score_rebuild(spark, d):
    return reports.rebuilt_scores(_event_rows(spark, d))


REBUILD_SQL = EVENTS_SQL + """ SELECT game_id, CAST(COALESCE(sum(GREATEST(runs, 0)) FILTER (WHERE NOT top), 0) AS DOUBLE) AS home_score,
  CAST(COALESCE(sum(GREATEST(runs, 0)) FILTER (WHERE top), 0) AS DOUBLE) AS away_score FROM ev GROUP BY game_id"""

PLAYS = ("左本塁打", "右二塁打 打点1", "三塁打", "四球", "死球", "空三振", "犠打", "犠飛 打点1", "併殺", "失策", "中安打", "ゴロ", "フライ", "ライナー", "盗塁", "投手交代")


def _plays(spark, d):
    li = adapters.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    names = F.array(*[F.lit(p) for p in PLAYS])
    return li.select(
        F.col("l_orderkey").alias("game_id"), F.when(F.col("l_suppkey") % 2 == 0, "home").otherwise("away").alias("side"),
        (F.col("l_partkey") % 5).cast("string").alias("player_id"),
        F.element_at(names, ((F.col("l_partkey") + F.col("l_linenumber")) % len(PLAYS) + 1).cast("int")).alias("event"),
    )


def play_counters(spark, d):
    df = reports.play_counters(_plays(spark, d))
    return df.select("game_id", "side", "player_id", "pa", "ab", "h", "hr", "doubles", "triples", "bb", "hbp", "so", "rbi", "sh", "sf", "gidp", "errors", "groundout", "contact_events", "event_count")


def _plays_sql():
    n = lambda *ids: f"count(*) FILTER (WHERE k IN ({', '.join(map(str, ids))}))"
    c = {
        "pa0": n(*range(14)), "ab": n(0, 1, 2, 5, 8, 9, 10, 11, 12, 13), "h": n(0, 1, 2, 10), "hr": n(0), "doubles": n(1), "triples": n(2), "bb": n(3), "hbp": n(4),
        "so": n(5), "rbi": n(1, 7), "sh": n(6), "sf": n(7), "gidp": n(8), "errors": n(9), "groundout": n(11), "contact_events": n(0, 1, 2, 10), "event_count": n(*range(15)),
    }
    return f"""WITH p AS (SELECT l_orderkey AS game_id, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, CAST(l_partkey % 5 AS VARCHAR) AS player_id,
      (l_partkey + l_linenumber) % {len(PLAYS)} AS k FROM lineitem), g AS (SELECT game_id, side, player_id, {', '.join(f'{e} AS {x}' for x, e in c.items())} FROM p GROUP BY 1, 2, 3)
    SELECT * EXCLUDE (pa0), pa0 AS pa FROM g WHERE event_count > 0 OR pa0 > 0"""


def batting_totals(spark, d):
    df = adapters.player_games(spark, d).withColumn("side", F.when(F.col("player_id") % 2 == 0, "home").otherwise("away"))
    return reports.team_batting(df, ["pa", "ab", "h", "hr", "bb", "so"])


def _totals_sql():
    from matchloom.suite.history import PLAYER_SQL

    s = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("pa", "ab", "h", "hr", "bb", "so"))
    return f"WITH {PLAYER_SQL} SELECT game_id, CASE WHEN player_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, {s} FROM player_games GROUP BY 1, 2"


def pitcher_lines(spark, d):
    li = adapters.table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_partkey")
    per = li.groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("pitcher")).agg(
        F.floor(F.max("l_quantity") / 10).alias("ip"), (F.max("l_partkey") % 3).alias("ip3"), (F.max("l_partkey") % 6).alias("er"),
        (F.max("l_partkey") % 9).alias("h"), (F.max("l_partkey") % 2).alias("hr"), (F.max("l_partkey") % 5).alias("bb"), (F.max("l_partkey") % 8).alias("so"),
    )
    return rounded(reports.pitching_line(per), ["game_id", "pitcher"], ["ip", "era", "whip", "k9", "bb9", "hr9", "fip", "k_rate", "bb_rate", "k_minus_bb"])


def _lines_sql():
    e = {
        "ip": "ip", "era": "9 * er / ip", "whip": "(h + bb) / ip", "k9": "9 * so / ip", "bb9": "9 * bb / ip", "hr9": "9 * hr / ip",
        "fip": "(13 * hr + 3 * bb - 2 * so) / ip + 3.2", "k_rate": "so / GREATEST(ip * 3, 1)", "bb_rate": "bb / GREATEST(ip * 3, 1)",
        "k_minus_bb": "so / GREATEST(ip * 3, 1) - bb / GREATEST(ip * 3, 1)",
    }
    return f"""WITH b AS (SELECT l_orderkey AS game_id, l_suppkey AS pitcher, floor(max(l_quantity) / 10) + (max(l_partkey) % 3) / 3.0E0 AS ip, max(l_partkey) % 6 AS er,
      max(l_partkey) % 9 AS h, max(l_partkey) % 2 AS hr, max(l_partkey) % 5 AS bb, max(l_partkey) % 8 AS so FROM lineitem GROUP BY 1, 2)
    SELECT game_id, pitcher, {', '.join(_r(x, n) for n, x in e.items())} FROM b WHERE ip > 0"""


def first_pitcher(spark, d):
    li = adapters.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    serial = F.concat(
        F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.when(F.col("l_linestatus") == "O", "T").otherwise("B"),
        F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"),
    )
    at = li.select(F.col("l_orderkey").alias("game_id"), serial.alias("serial"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey").cast("string")).alias("pitcher_id"))
    return reports.first_pitchers(at)


FIRST_SQL = """WITH a AS (SELECT l_orderkey AS game_id, lpad(l_linenumber::VARCHAR, 2, '0') || CASE WHEN l_linestatus = 'O' THEN 'T' ELSE 'B' END || lpad(l_partkey::VARCHAR, 8, '0') || lpad(l_suppkey::VARCHAR, 6, '0') AS s,
  l_linestatus = 'O' AS top, l_suppkey::VARCHAR AS p FROM lineitem WHERE l_suppkey % 5 > 0)
SELECT game_id, COALESCE(arg_min(p, s) FILTER (WHERE NOT top), '') AS home_starter, COALESCE(arg_min(p, s) FILTER (WHERE top), '') AS away_starter FROM a GROUP BY game_id"""


QUERIES = {
    "oos_summary": oos_summary, "leaderboard": leaderboard, "category_metrics": category_metrics, "calibration_bins": calibration_bins,
    "auc_rank": auc_rank, "basic_metrics": basic_metrics, "ece_bundle": ece_bundle, "condition_accuracy": condition_accuracy,
    "condition_accuracy_grouping_sets": condition_cube, "competition_counts": competition_counts, "coverage_gate": coverage_gate,
    "season_status": season_status, "quality_profile": quality_profile, "probability_integrity": probability_integrity,
    "state_kind_pivot": state_kind_pivot, "pit_counters": pit_counters, "base_rate": base_rate, "high_confidence_error": high_confidence,
    "score_dispersion": dispersion, "shared_lambda": shared_lambda, "low_high_confusion": low_high_confusion,
    "weakness_priorities": weakness_priorities, "segment_counts": segment_counts, "status_rollup": status_rollup,
    "category_ablation": category_ablation, "game_aggregate": game_aggregate, "score_rebuild": score_rebuild, "play_counters": play_counters,
    "batting_totals": batting_totals, "pitcher_lines": pitcher_lines, "first_pitcher": first_pitcher,
}
ORACLES = {
    "oos_summary": with_views(SCORED_SQL + f" SELECT league, count(*) AS predictions, {SUMMARY_SQL} FROM scored GROUP BY league"),
    "leaderboard": with_views(
        SCORED_SQL + f""", g AS (SELECT model, count(*) AS predictions, avg(correct) AS accuracy, avg(logloss) AS logloss, avg(brier) AS brier FROM scored GROUP BY model)
        SELECT model, row_number() OVER (ORDER BY logloss, brier, accuracy DESC, model) AS rank, predictions, {_r('accuracy', 'accuracy')}, {_r('logloss', 'logloss')}, {_r('brier', 'brier')} FROM g"""
    ),
    "category_metrics": with_views(SCORED_SQL + f" SELECT game_category, count(*) AS predictions, {SUMMARY_SQL} FROM scored GROUP BY game_category"),
    "calibration_bins": _calibration_sql(), "auc_rank": AUC_SQL, "basic_metrics": BASIC_SQL,
    "ece_bundle": with_views(f", n AS (SELECT *, {NORM} FROM predictions), {bundle_sql('n', 'league, model')} SELECT league, model, rows, {MET} FROM met"),
    "condition_accuracy": CONDITION_SQL,
    "condition_accuracy_grouping_sets": with_views(N_SQL + f" SELECT league, game_category, count(*) AS samples, {_r('avg(correct)', 'accuracy')} FROM scored GROUP BY GROUPING SETS ((league, game_category), (league), (game_category), ())"),
    "competition_counts": COMPETITION_SQL, "coverage_gate": COVERAGE_SQL, "season_status": SEASON_SQL, "quality_profile": _quality_sql(),
    "probability_integrity": INTEGRITY_SQL, "state_kind_pivot": _pivot_sql(), "pit_counters": PIT_COUNTERS_SQL, "base_rate": BASE_SQL,
    "high_confidence_error": HIGH_SQL, "score_dispersion": DISPERSION_SQL, "shared_lambda": SHARED_SQL, "low_high_confusion": CONFUSION_SQL,
    "weakness_priorities": WEAKNESS_SQL, "segment_counts": SEGMENT_SQL, "status_rollup": ROLLUP_SQL, "category_ablation": ABLATION_SQL,
    "game_aggregate": GAME_SQL, "score_rebuild": REBUILD_SQL, "play_counters": _plays_sql(), "batting_totals": _totals_sql(),
    "pitcher_lines": _lines_sql(), "first_pitcher": FIRST_SQL,
}
