"""Registered queries over chronological history, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import form
from matchloom.sources import adapters
from matchloom.sources.adapters import with_views


def rounded(df: DataFrame, keys, values, places: int = 6) -> DataFrame:
    """Values rounded for comparison; the nudge keeps exact halves from falling either way by an ulp."""
    nudged = df.select(*keys, *[(F.col(v).cast("double") + 1e-9).alias(v) for v in values])
    return nudged.select(*keys, *[_round(F.col(v), places).alias(v) for v in values])


def _round(x: Column, places: int) -> Column:
    """``F.round`` of a double, which goes by way of decimal text, for what lies close to a half, is large or not a number;
    the whole number of units nearest to the others is the same by plain arithmetic."""
    units = x * F.lit(10.0**places)
    plain = (F.abs(units) < 1e12) & (F.abs(units - F.floor(units) - 0.5) > 1e-3)
    return F.when(plain, F.floor(units + 0.5) / F.lit(10.0**places)).otherwise(F.round(x, places))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return form.team_rows(adapters.matches(spark, d))


KEYS = ["game_id", "team"]
W = "PARTITION BY league, team ORDER BY datetime, game_id"
# State after the last eligible game before the row: eligible-only window, then the last value seen.
ELIGIBLE = """
seen AS (SELECT *, count(*) FILTER (WHERE eligible) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_n FROM {src}),
live AS (SELECT *, row_number() OVER ({w}) AS idx FROM {src} WHERE eligible)
"""


def _r(expr: str, name: str, places: int = 6) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE) + 1e-9, {places}) AS {name}"


# ---- rolling form -----------------------------------------------------------------------------


def rolling_form(spark, d):
    df = form.rolling_form(_rows(spark, d))
    values = [f"{n}_{w}" for w in form.FORM_WIDTHS for n in ("pts", "gf", "ga", "gd", "win", "draw")]
    return rounded(df, KEYS, values)


def _form_sql():
    base = {
        "pts": ("CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END", 1.0), "gf": ("gf", 0.0), "ga": ("ga", 0.0),
        "win": ("CASE WHEN gf > ga THEN 1 ELSE 0 END", 0.33), "draw": ("CASE WHEN gf = ga THEN 1 ELSE 0 END", 0.33),
    }
    state, out = [], []
    for w in form.FORM_WIDTHS:
        for n, (e, _) in base.items():
            state.append(f"avg({e}) OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {n}_{w}")
        c = {n: f"COALESCE(l.{n}_{w}, {dflt}E0)" for n, (_, dflt) in base.items()}
        out += [_r(c[n], f"{n}_{w}") for n in base] + [_r(f"{c['gf']} - {c['ga']}", f"gd_{w}")]
    return with_views(
        ","
        + ELIGIBLE.format(w=W, src="team_rows")
        + f", st AS (SELECT league, team, idx, {', '.join(state)} FROM live)\n"
        f"SELECT s.game_id, s.team, {', '.join(out)} FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n"
    )


# ---- flagship: one row per game ----------------------------------------------------------------


def match_form(spark, d):
    """Ten-game form and rest of both sides, per game."""
    rows = form.rest_days(form.rolling_form(_rows(spark, d), [10]))
    names = ["pts_10", "gd_10", "win_10", "rest_days"]
    df = form.game_differences(rows, names)
    return rounded(df, ["game_id", "league"], [f"{p}_{n}" for n in names for p in "had"])


def _match_form_sql():
    names = {
        "pts_10": ("avg(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END)", "1.0E0"),
        "gd_10": ("avg(gf) OVER (x) - avg(ga)", "0.0E0"), "win_10": ("avg(CASE WHEN gf > ga THEN 1 ELSE 0 END)", "0.33E0"),
    }
    frame = f"{W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"
    state = [f"{e.replace('(x)', f'({frame})')} OVER ({frame}) AS {n}" for n, (e, _) in names.items()]
    cols = [f"COALESCE(l.{n}, {dflt}) AS {n}" for n, (_, dflt) in names.items()]
    rest = "COALESCE(GREATEST((epoch_us(s.datetime) - epoch_us(l.datetime)) / 86400000000.0E0, 0.0E0), 30.0E0) AS rest_days"
    out = []
    for n in [*names, "rest_days"]:
        h, a = f"max({n}) FILTER (WHERE is_home)", f"max({n}) FILTER (WHERE NOT is_home)"
        out += [_r(h, f"h_{n}"), _r(a, f"a_{n}"), _r(f"{h} - {a}", f"d_{n}")]
    return with_views(
        "," + ELIGIBLE.format(w=W, src="team_rows") + f", st AS (SELECT league, team, idx, datetime, {', '.join(state)} FROM live),\n"
        f"f AS (SELECT s.game_id, s.league, s.is_home, {', '.join(cols)}, {rest} FROM seen s LEFT JOIN st l "
        "ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n)\n"
        f"SELECT game_id, league, {', '.join(out)} FROM f GROUP BY game_id, league"
    )


def venue_split(spark, d):
    return rounded(form.venue_split(_rows(spark, d)), KEYS, ["venue_n", "venue_pts", "venue_gf", "venue_ga"])


def _venue_split_sql():
    w = "PARTITION BY league, team, is_home ORDER BY datetime, game_id"
    pts = "CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END"
    return with_views(
        "," + ELIGIBLE.format(w=w, src="team_rows") +
        f""", st AS (SELECT league, team, is_home, idx, avg({pts}) OVER ({w} ROWS UNBOUNDED PRECEDING) AS p,
          avg(gf) OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS g, avg(ga) OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM live)
        SELECT s.game_id, s.team, {_r('s.before_n', 'venue_n')}, {_r('COALESCE(p, 1)', 'venue_pts')},
          {_r('COALESCE(g, 0)', 'venue_gf')}, {_r('COALESCE(a, 0)', 'venue_ga')}
        FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.is_home = s.is_home AND l.idx = s.before_n"""
    )


def shrunk_win_rate(spark, d):
    df = form.shrunk_win_rate(_rows(spark, d))
    return rounded(df, KEYS, ["matches", "win_rate_raw", "win_rate_shrunk"])


SHRUNK_SQL = with_views(
    f""", s AS (SELECT game_id, team,
        count(*) FILTER (WHERE eligible) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
        count(*) FILTER (WHERE eligible AND gf > ga) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM team_rows)
    SELECT game_id, team, {_r('n', 'matches')}, {_r('k / GREATEST(n, 1)::DOUBLE', 'win_rate_raw')},
        {_r('(k + 50.0E0) / (n + 100.0E0)', 'win_rate_shrunk')} FROM s"""
)


def rest_days(spark, d):
    return rounded(form.rest_days(_rows(spark, d)), KEYS, ["rest_days", "short_rest"])


REST_SQL = with_views(
    f""", s AS (SELECT game_id, team, datetime, max(CASE WHEN eligible THEN datetime END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM team_rows),
    r AS (SELECT game_id, team, COALESCE(GREATEST((epoch_us(datetime) - epoch_us(p)) / 86400000000.0E0, 0.0E0), 30.0E0) AS x FROM s)
    SELECT game_id, team, {_r('x', 'rest_days')}, CASE WHEN x < 2 THEN 1.0E0 ELSE 0.0E0 END AS short_rest FROM r"""
)


def games_last_nd(spark, d):
    return form.games_last_days(_rows(spark, d)).select(*KEYS, "games_last_3d", "games_last_7d", "games_last_14d")


def _last_nd_sql():
    cols = ", ".join(
        f"CAST(count(*) FILTER (WHERE eligible) OVER (PARTITION BY league, team ORDER BY datetime "
        f"RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS BIGINT) AS games_last_{n}d"
        for n in (3, 7, 14)
    )
    return with_views(f"SELECT game_id, team, {cols} FROM team_rows")


def same_opponent(spark, d):
    return rounded(form.same_opponent(_rows(spark, d)), KEYS, ["same_opponent_last_10"])


SAME_OPP_SQL = with_views(
    "," + ELIGIBLE.format(w=W, src="team_rows") +
    """ SELECT s.game_id, s.team, CAST(count(l.idx) AS DOUBLE) AS same_opponent_last_10 FROM seen s LEFT JOIN live l
    ON l.league = s.league AND l.team = s.team AND l.idx BETWEEN s.before_n - 9 AND s.before_n AND l.opponent = s.opponent GROUP BY 1, 2"""
)


def _batting_rows(spark, d):
    """Team batting per game from the batting lines, joined to the unpivoted games."""
    lines = adapters.player_games(spark, d)
    cols = ["pa", "ab", "h", "hr", "bb", "so", "doubles"]
    sides = lines.groupBy("game_id", (F.col("player_id") % 2 == 0).alias("is_home")).agg(*[F.sum(c).alias(c) for c in cols])
    return _rows(spark, d).join(sides, ["game_id", "is_home"], "left")


def batting_process(spark, d):
    df = form.batting_process(_batting_rows(spark, d))
    return rounded(df, KEYS, [c for c in df.columns if c.startswith("bat_")])


PLAYER_SQL = """
player_games AS (SELECT game_id, player_id, pa, CAST(floor(pa * 0.85E0) AS BIGINT) AS ab, CAST(floor(pa * 0.25E0) AS BIGINT) AS h,
   m % 3 AS doubles, m % 2 AS hr, CAST(floor(pa * 0.1E0) AS BIGINT) AS bb, CAST(floor(pa * 0.2E0) AS BIGINT) AS so
  FROM (SELECT l_orderkey AS game_id, l_partkey AS player_id, CAST(floor(sum(l_quantity)) AS BIGINT) AS pa, min(l_suppkey) AS m FROM lineitem GROUP BY 1, 2))
"""


def _batting_sql():
    cols = ["pa", "ab", "h", "hr", "bb", "so", "doubles"]
    sides = ", ".join(f"sum({c}) AS {c}" for c in cols)
    state, out = [], []
    for w in form.BAT_WIDTHS:
        f = f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        state += [f"avg(COALESCE({c}, 0)) {f} AS {c}_{w}" for c in cols]
        m = {c: f"COALESCE({c}_{w}, 0)" for c in cols}
        ab, pa = f"GREATEST({m['ab']}, 1)", f"GREATEST({m['pa']}, 1)"
        extra = f"(({m['doubles']} + 3 * {m['hr']}) / {ab})"
        out += [
            _r(f"{m['h']} / {ab}", f"bat_avg_{w}"), _r(f"{m['bb']} / {pa}", f"bat_bb_rate_{w}"), _r(f"{m['so']} / {pa}", f"bat_so_rate_{w}"),
            _r(f"{m['doubles']} + {m['hr']}", f"bat_xbh_{w}"), _r(f"{m['hr']} / {ab}", f"bat_hr_rate_{w}"),
            _r(f"GREATEST({extra} - {m['h']} / {ab}, 0)", f"bat_iso_{w}"), _r(f"GREATEST({extra}, 0)", f"bat_extra_{w}"),
        ]
    return with_views(
        f", {PLAYER_SQL}, sides AS (SELECT game_id, player_id % 2 = 0 AS is_home, {sides} FROM player_games GROUP BY 1, 2), "
        f"rows_b AS (SELECT t.*, {', '.join('b.' + c for c in cols)} FROM team_rows t LEFT JOIN sides b ON b.game_id = t.game_id AND b.is_home = t.is_home), "
        + ELIGIBLE.format(w=W, src="rows_b")
        + f", st AS (SELECT league, team, idx, {', '.join(state)} FROM live) SELECT s.game_id, s.team, {', '.join(out)} "
        "FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n"
    )


def bullpen_load(spark, d):
    return rounded(form.bullpen(_rows(spark, d)), KEYS, ["bp_er_10", "bp_runs_10", "bp_app_10"])


BULLPEN_SQL = with_views(
    "," + ELIGIBLE.format(w=W, src="team_rows") +
    f""", st AS (SELECT league, team, idx, avg(GREATEST(ga - 3, 0)) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS e FROM live)
    SELECT s.game_id, s.team, {_r('COALESCE(e, 0)', 'bp_er_10')}, {_r('COALESCE(e, 0)', 'bp_runs_10')}, 0.0E0 AS bp_app_10
    FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n"""
)


def bullpen_decay(spark, d):
    return rounded(form.bullpen_decay(_rows(spark, d)), KEYS, ["bp3", "bp7"])


BULLPEN_DECAY_SQL = with_views(
    "," + ELIGIBLE.format(w=W, src="team_rows") +
    f""", st AS (SELECT league, team, idx, list(GREATEST(ga - 3, 0)::DOUBLE) OVER ({W} ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS xs FROM live)
    SELECT s.game_id, s.team,
      {_r('COALESCE(list_reduce(list_prepend(0.0E0, xs), lambda a, x: a * 0.65E0 + x * 0.45E0), 0)', 'bp3')},
      {_r('COALESCE(list_reduce(list_prepend(0.0E0, xs), lambda a, x: a * 0.88E0 + x * 0.2E0), 0)', 'bp7')}
    FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n"""
)


def h2h_last8(spark, d):
    df = form.head_to_head(adapters.matches(spark, d))
    return rounded(df, ["game_id", "h2h_n"], ["h2h_home_win_rate", "h2h_draw_rate"])


H2H_SQL = with_views(
    f""", p AS (SELECT *, CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away ELSE '' END AS w FROM matches),
    q AS (SELECT *, list(w) OVER (PARTITION BY league, LEAST(home, away), GREATEST(home, away) ORDER BY datetime, game_id
          ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS ws FROM p)
    SELECT game_id, CAST(COALESCE(len(ws), 0) AS BIGINT) AS h2h_n,
      {_r("CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: x = home)) / len(ws) END", 'h2h_home_win_rate')},
      {_r("CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: x = '')) / len(ws) END", 'h2h_draw_rate')} FROM q"""
)


def recent_form(spark, d):
    """Points and goal difference per game over 5 and 10 games; null without history."""
    df = form.rolling_form(_rows(spark, d), [5, 10], neutral=False)
    return rounded(df, KEYS, ["pts_5", "pts_10", "gd_5", "gd_10"])


def _recent_sql():
    pts = "CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END"
    st = ", ".join(
        f"avg({e}) OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {n}_{w}" for w in (5, 10) for n, e in (("pts", pts), ("gd", "gf - ga"))
    )
    out = ", ".join(_r(f"{n}_{w}", f"{n}_{w}") for w in (5, 10) for n in ("pts", "gd"))
    return with_views(
        "," + ELIGIBLE.format(w=W, src="team_rows") + f", st AS (SELECT league, team, idx, {st} FROM live) SELECT s.game_id, s.team, {out} "
        "FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n"
    )


def volatility_slope(spark, d):
    return rounded(form.volatility(_rows(spark, d)), KEYS, ["gf_sd_20", "gf_slope_20", "ga_sd_20", "ga_slope_20"])


def _vol_sql():
    f = f"OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    st = ", ".join(f"stddev_pop({n}) {f} AS sd_{n}, regr_slope({n}, idx) {f} AS sl_{n}" for n in ("gf", "ga"))
    out = ", ".join(
        _r(f"CASE WHEN s.before_n >= 2 THEN sd_{n} ELSE 0 END", f"{n}_sd_20") + ", " + _r(f"CASE WHEN s.before_n >= 4 THEN sl_{n} ELSE 0 END", f"{n}_slope_20")
        for n in ("gf", "ga")
    )
    return with_views(
        "," + ELIGIBLE.format(w=W, src="team_rows") + f", st AS (SELECT league, team, idx, {st} FROM live) SELECT s.game_id, s.team, {out} "
        "FROM seen s LEFT JOIN st l ON l.league = s.league AND l.team = s.team AND l.idx = s.before_n"
    )


def venue_env(spark, d):
    df = form.venue_environment(adapters.matches(spark, d))
    return rounded(df, ["game_id"], ["venue_known", "venue_games", "venue_run_env", "venue_home_win_rate", "venue_draw_rate"])


def _venue_env_sql():
    w = "OVER (PARTITION BY league, venue ORDER BY datetime, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    e = "FILTER (WHERE training_included)"
    return with_views(
        f""", v AS (SELECT game_id, count(*) {e} {w} AS n, COALESCE(sum(home_score + away_score) {e} {w}, 0) AS runs,
          count(*) FILTER (WHERE training_included AND home_score > away_score) {w} AS wins,
          count(*) FILTER (WHERE training_included AND home_score = away_score) {w} AS draws FROM matches)
        SELECT game_id, CASE WHEN n >= 3 THEN 1.0E0 ELSE 0.0E0 END AS venue_known, CAST(n AS DOUBLE) AS venue_games,
          {_r('CASE WHEN n >= 3 THEN runs / n ELSE 0 END', 'venue_run_env')},
          {_r('CASE WHEN n >= 3 THEN wins / n ELSE 1 / 3.0E0 END', 'venue_home_win_rate')},
          {_r('CASE WHEN n >= 3 THEN draws / n ELSE 1 / 3.0E0 END', 'venue_draw_rate')} FROM v"""
    )


def context_readiness(spark, d):
    g = adapters.matches(spark, d)
    valid, safe = F.col("game_id") % 5 != 0, F.col("game_id") % 3 != 0
    df = form.context_readiness(g, valid, safe)
    return df.select("game_id", "valid_seen", "safe_seen", "context_ready")


def _ready_sql():
    w = "OVER (PARTITION BY league ORDER BY datetime, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    v = "training_included AND game_id % 5 <> 0"
    return with_views(
        f""", c AS (SELECT game_id, CAST(count(*) FILTER (WHERE {v}) {w} AS BIGINT) AS valid_seen,
        CAST(count(*) FILTER (WHERE {v} AND game_id % 3 <> 0) {w} AS BIGINT) AS safe_seen FROM matches)
        SELECT *, valid_seen > 0 AND safe_seen >= 0.5E0 * valid_seen AS context_ready FROM c"""
    )


def _pitcher_lines(spark, d):
    lines = adapters.table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    per = lines.groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("pitcher")).agg(
        F.sum("l_quantity").alias("pitches"),
        (F.round(F.sum("l_discount"), 4) * 40).alias("era"),
        (F.round(F.sum("l_tax"), 4) * 60).alias("k9"),
    )
    games = adapters.matches(spark, d).select("game_id", "league", "datetime", F.col("training_included").alias("eligible"))
    return per.join(games, "game_id")


def starter_profile(spark, d):
    df = form.starter_profiles(_pitcher_lines(spark, d))
    names = ["sp_starts", "sp_era", "sp_k9", "sp_recent_era", "sp_recent_k9", "sp_recent_pitches", "sp_recent_era_sd", "sp_era_slope", "sp_k9_slope"]
    return rounded(df, ["game_id", "pitcher"], names, 5)


def _starter_sql():
    w = "PARTITION BY league, pitcher ORDER BY datetime, game_id"
    dec = lambda m: f"list_sum(list_transform(xs, lambda r, i: r.{m} * exp((i - len(xs)) / 18.0E0))) / list_sum(list_transform(xs, lambda r, i: exp((i - len(xs)) / 18.0E0)))"
    tail = lambda m, n: f"list_transform(xs[-{n}:], lambda r: r.{m})"
    slope = lambda m: (
        f"CASE WHEN len(xs) >= 3 THEN (SELECT regr_slope(v, i) FROM (SELECT unnest({tail(m, 8)}) AS v, generate_subscripts({tail(m, 8)}, 1) AS i)) END"
    )
    r5 = lambda e, n: _r(e, n, 5)
    return with_views(
        f""", pl AS (SELECT l_orderkey AS game_id, l_suppkey AS pitcher, sum(l_quantity) AS pitches, ROUND(sum(l_discount), 4) * 40 AS era, ROUND(sum(l_tax), 4) * 60 AS k9
          FROM lineitem GROUP BY 1, 2),
        p AS (SELECT pl.*, m.league, m.datetime, m.training_included AS eligible FROM pl JOIN matches m ON m.game_id = pl.game_id),
        {ELIGIBLE.format(w=w, src="p")},
        st AS (SELECT league, pitcher, idx, list({{'era': era, 'k9': k9, 'pitches': pitches}}) OVER ({w} ROWS BETWEEN 599 PRECEDING AND CURRENT ROW) AS xs FROM live),
        j AS (SELECT s.game_id, s.pitcher, s.before_n, xs FROM seen s LEFT JOIN st l ON l.league = s.league AND l.pitcher = s.pitcher AND l.idx = s.before_n)
        SELECT game_id, pitcher, CAST(before_n AS DOUBLE) AS sp_starts, {r5(f"COALESCE({dec('era')}, 4)", 'sp_era')}, {r5(f"COALESCE({dec('k9')}, 7.5)", 'sp_k9')},
          {r5(f"COALESCE(list_avg({tail('era', 5)}), 4)", 'sp_recent_era')}, {r5(f"COALESCE(list_avg({tail('k9', 5)}), 7.5)", 'sp_recent_k9')},
          {r5(f"COALESCE(list_avg({tail('pitches', 5)}), 0)", 'sp_recent_pitches')}, {r5(f"COALESCE(list_stddev_pop({tail('era', 5)}), 0)", 'sp_recent_era_sd')},
          {r5(f"COALESCE({slope('era')}, 0)", 'sp_era_slope')}, {r5(f"COALESCE({slope('k9')}, 0)", 'sp_k9_slope')} FROM j"""
    )


def player_profile(spark, d):
    games = adapters.matches(spark, d).select("game_id", "league", "datetime", F.col("training_included").alias("eligible"))
    df = form.player_profiles(adapters.player_games(spark, d).join(games, "game_id"))
    names = ["pp_games", "pp_avg", "pp_obp", "pp_slg", "pp_iso", "pp_bb_rate", "pp_so_rate", "pp_recent_pa", "pp_recent_iso"]
    return rounded(df, ["game_id", "player_id"], names)


def _player_sql(more=(), recent_of=("pa", "iso")):
    """``more`` names rates whose counters the given lines lack: zero with history, a prior without."""
    w = "PARTITION BY league, player_id ORDER BY datetime, game_id"
    rates = {
        "avg": "h / GREATEST(ab, 1)", "obp": "(h + bb) / GREATEST(ab + bb, 1)", "slg": "(h + doubles + 3 * hr) / GREATEST(ab, 1)",
        "iso": "GREATEST((h + doubles + 3 * hr) / GREATEST(ab, 1) - h / GREATEST(ab, 1), 0)", "bb_rate": "bb / GREATEST(pa, 1)", "so_rate": "so / GREATEST(pa, 1)", "pa": "pa",
    }
    rates |= {m: "0" for m in more}
    packed = ", ".join(f"'{n}': ({e})::DOUBLE" for n, e in rates.items())
    wt = "exp((i - len(xs)) / 12.0E0)"
    dec = lambda m: f"list_sum(list_transform(xs, lambda r, i: r.{m} * {wt})) / list_sum(list_transform(xs, lambda r, i: {wt}))"
    prior = {"avg": 0.25, "obp": 0.32, "slg": 0.38, "iso": 0.13, "bb_rate": 0.08, "so_rate": 0.2} | {m: form.PLAYER_PRIOR[m] for m in more}
    out = ", ".join(_r(f"COALESCE({dec(m)}, {v})", f"pp_{m}") for m, v in prior.items())
    rec = ", ".join(_r(f"COALESCE(list_avg(list_transform(xs[-5:], lambda r: r.{m})), {v})", f"pp_recent_{m}") for m, v in ((m, form.PLAYER_PRIOR[m]) for m in recent_of))
    return with_views(
        f""", {PLAYER_SQL}, p AS (SELECT g.*, m.league, m.datetime, m.training_included AS eligible FROM player_games g JOIN matches m ON m.game_id = g.game_id),
        {ELIGIBLE.format(w=w, src="p")}, st AS (SELECT league, player_id, idx, list({{{packed}}}) OVER ({w} ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS xs FROM live)
        SELECT s.game_id, s.player_id, CAST(s.before_n AS DOUBLE) AS pp_games, {out}, {rec} FROM seen s LEFT JOIN st l
        ON l.league = s.league AND l.player_id = s.player_id AND l.idx = s.before_n"""
    )


QUERIES = {
    "match_form": match_form, "rolling_form": rolling_form, "venue_split": venue_split, "shrunk_win_rate": shrunk_win_rate,
    "rest_days": rest_days, "games_last_nd": games_last_nd, "same_opponent": same_opponent, "batting_process": batting_process,
    "bullpen_load": bullpen_load, "bullpen_decay": bullpen_decay, "h2h_last8": h2h_last8, "recent_form": recent_form,
    "volatility_slope": volatility_slope, "venue_env": venue_env, "context_readiness": context_readiness,
    "starter_profile": starter_profile, "player_profile": player_profile,
}
ORACLES = {
    "match_form": _match_form_sql(), "rolling_form": _form_sql(), "venue_split": _venue_split_sql(), "shrunk_win_rate": SHRUNK_SQL,
    "rest_days": REST_SQL, "games_last_nd": _last_nd_sql(), "same_opponent": SAME_OPP_SQL, "batting_process": _batting_sql(),
    "bullpen_load": BULLPEN_SQL, "bullpen_decay": BULLPEN_DECAY_SQL, "h2h_last8": H2H_SQL, "recent_form": _recent_sql(),
    "volatility_slope": _vol_sql(), "venue_env": _venue_env_sql(), "context_readiness": _ready_sql(),
    "starter_profile": _starter_sql(), "player_profile": _player_sql(),
}
