"""Registered source, harmonisation, join and set queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.operators import form, harmonise, joins
from matchloom.plans.durable import fresh_path
from matchloom.plans.ordered import Timeline, latest_per_key
from matchloom.sources import adapters, readers, store
from matchloom.sources.adapters import with_views
from matchloom.suite.history import _r, rounded
from matchloom.suite.reports import TYPE_CATEGORY, TYPED_SQL, _typed_games

T = adapters.table


def outcome_label(spark, d):
    h, a = F.col("home_score"), F.col("away_score")
    return adapters.matches(spark, d).select(
        "game_id", harmonise.outcome(h, a).alias("three_way"), harmonise.outcome(h, a, 2).alias("two_way"), harmonise.outcome_letter(h, a).alias("letter")
    )


def team_unpivot(spark, d):
    rows = form.team_rows(adapters.matches(spark, d))
    return rows.groupBy("league", "team").agg(
        F.count(F.lit(1)).alias("games"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.count_if("is_home").alias("home_games"),
        F.count_if(F.col("gf") > F.col("ga")).alias("wins"),
    )


def taxonomy_classify(spark, d):
    return harmonise.classify(_typed_games(spark, d)).select("game_id", "category", "confidence", "training_default", "evaluation_default")


TAXONOMY_SQL = with_views(
    TYPED_SQL + """ SELECT game_id, category, CASE WHEN category = 'unknown' THEN 'low' ELSE 'high' END AS confidence,
    category IN ('regular', 'interleague') AS training_default, category IN ('regular', 'interleague', 'climax', 'japan_series', 'allstar', 'special') AS evaluation_default FROM typed"""
)


def category_override(spark, d):
    games = harmonise.classify(_typed_games(spark, d))
    codes = T(spark, d, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("game_id"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 40).cast("string")).alias("kind_code")
    )
    out = harmonise.override_category(games, codes.filter("kind_code is not null"))
    return out.select("game_id", "category", "category_recovered", "training_default", "evaluation_default")


def _override_sql():
    codes = " ".join(f"WHEN {k} THEN '{v}'" for k, v in harmonise.KIND_CODES.items())
    tr, ev = "('regular', 'interleague')", "('regular', 'interleague', 'climax', 'japan_series', 'allstar', 'special')"
    return with_views(
        TYPED_SQL + f""", r AS (SELECT t.game_id, t.category AS c0, CASE WHEN o.o_orderkey % 3 = 0 THEN CASE o.o_custkey % 40 {codes} END END AS raw
          FROM typed t JOIN orders o ON o.o_orderkey = t.game_id), z AS (SELECT game_id, COALESCE(raw, c0) AS category, raw IS NOT NULL AS category_recovered FROM r)
        SELECT *, category IN {tr} AS training_default, category IN {ev} AS evaluation_default FROM z"""
    )


def safe_parse(spark, d):
    """Alias picking, number parsing, canonical names and flags over untyped text."""
    s = T(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    raw = s.select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 4 == 0, "-").when(F.col("s_suppkey") % 4 == 1, " nan ").otherwise(F.format_number("s_acctbal", 2)).alias("HScore"),
        F.concat(F.col("s_suppkey").cast("string"), F.lit(",000")).alias("away_score"),
        F.when(F.col("s_suppkey") % 3 == 0, "巨人").when(F.col("s_suppkey") % 3 == 1, " 阪神 ").otherwise(F.col("s_name")).alias("home"),
        F.when(F.col("s_suppkey") % 2 == 0, " TRUE ").otherwise("no").alias("flag"),
    )
    value = text.number(text.pick(raw, ["home_score", "hscore", "AWAY_SCORE"]))
    return raw.select(
        "id", value.alias("value"), text.canonical(F.col("home"), harmonise.TEAM_ALIASES).alias("team"), text.truthy(F.col("flag")).alias("flag"),
        text.finite_or_zero(F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double"))).alias("clean"),
    )


SAFE_SQL = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 < 2 THEN CAST(s_suppkey AS DOUBLE) * 1000 ELSE CAST(format('{:.2f}', s_acctbal) AS DOUBLE) END AS value,
  CASE s_suppkey % 3 WHEN 0 THEN '読売ジャイアンツ' WHEN 1 THEN '阪神タイガース' ELSE s_name END AS team, s_suppkey % 2 = 0 AS flag,
  CASE WHEN s_suppkey % 5 = 0 THEN 0.0E0 ELSE CAST(s_suppkey AS DOUBLE) END AS clean FROM supplier"""


def local_time(spark, d):
    o = T(spark, d, "orders", "o_orderkey", "o_orderdate")
    clock = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.format_string("%02d%02d", (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int")))
    at = text.stamp(F.date_format("o_orderdate", "yyyy-MM-dd"), clock)
    return o.select(F.col("o_orderkey").alias("game_id"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("utc"))


LOCAL_SQL = """SELECT o_orderkey AS game_id, strftime(o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 18 HOUR
  ELSE to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT)) END - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS utc FROM orders"""


def pit_usable(spark, d):
    o = adapters.observations(spark, d)
    quality = F.when(F.col("event_id") % 4 == 0, "UNKNOWN").otherwise("ISSUED")
    weather = F.when(F.col("kind") == "WEATHER", harmonise.pit_usable(F.col("available_at"), F.col("prediction_time"), F.col("state"), weather_quality=quality))
    ok = F.coalesce(weather, harmonise.pit_usable(F.col("available_at"), F.col("prediction_time"), F.col("state")))
    return o.select("event_id", "game_id", "kind", ok.alias("usable"))


PIT_SQL = with_views(
    """SELECT event_id, game_id, kind, available_at <= prediction_time AND state IN ('VERIFIED', 'PROJECTED') AND NOT (kind = 'WEATHER' AND event_id % 4 = 0) AS usable FROM observations"""
)


def market_line(spark, d):
    p = adapters.predictions(spark, d)
    k = F.col("game_id")
    lines = p.withColumns(
        {
            "event_id": k.cast("string"), "line": (k % 20) / 2.0 - F.when(k % 50 == 3, 0.2).otherwise(0.0), "source": F.when(k % 30 == 1, "").otherwise("board"),
            "observed_at": F.when(k % 40 == 5, "soon").otherwise("2024-01-01 00:00:00"), "available_at": F.lit("2024-01-01 00:00:00"),
            "status": F.when(k % 9 == 0, "UNKNOWN").otherwise("KNOWN"),
        }
    )
    total = F.col("actual_home_score") + F.col("actual_away_score")
    return lines.select(
        "game_id", F.size(harmonise.line_violations(lines)).cast("long").alias("violations"), harmonise.line_result(total, F.col("line")).alias("result")
    )


MARKET_SQL = with_views(
    """, l AS (SELECT game_id, actual_home_score + actual_away_score AS t, (game_id % 20) / 2.0E0 - CASE WHEN game_id % 50 = 3 THEN 0.2E0 ELSE 0 END AS line FROM predictions),
    v AS (SELECT *, line < 0 OR game_id % 50 = 3 AS bad FROM l)
    SELECT game_id, CAST(CASE WHEN bad THEN 1 ELSE 0 END + CASE WHEN game_id % 30 = 1 THEN 1 ELSE 0 END + CASE WHEN game_id % 40 = 5 THEN 1 ELSE 0 END AS BIGINT) AS violations,
      CASE WHEN NOT bad THEN CASE WHEN line = floor(line) AND t = line THEN 'PUSH' WHEN t < line THEN 'LOW' ELSE 'HIGH' END END AS result FROM v"""
)


def forecast_gate(spark, d):
    g = adapters.matches(spark, d)
    state = F.when(F.col("game_id") % 3 == 0, "verified").when(F.col("game_id") % 3 == 1, "PROJECTED")
    gate = harmonise.eligibility(F.col("game_id") % 10 != 0, state)
    now = F.lit("1998-06-01").cast("timestamp")
    return g.select("game_id", harmonise.schedule_state(F.col("datetime").cast("timestamp"), now).alias("state"), gate["eligible"].alias("eligible"), gate["reason"].alias("reason"))


GATE_SQL = with_views(
    """SELECT game_id, CASE WHEN datetime > TIMESTAMP '1998-06-01' THEN 'FUTURE' ELSE 'STARTED' END AS state, game_id % 10 <> 0 AND game_id % 3 = 0 AS eligible,
    CASE WHEN game_id % 10 = 0 THEN 'MODEL_UNAVAILABLE' WHEN game_id % 3 <> 0 THEN 'STARTERS_UNCONFIRMED' ELSE 'READY' END AS reason FROM matches"""
)


def event_normalise(spark, d):
    li = T(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    seq = (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    raw = li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")).alias("GamePk"), seq.cast("string").alias("SeqNo"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.concat(F.lit("T"), (F.col("l_orderkey") % 30).cast("string")).alias("HomeTeam"),
        F.when(F.col("l_orderkey") % 50 == 0, "nan").otherwise("T99").alias("visitor"), F.lit("-").alias("HScore"), F.col("l_linenumber").cast("string").alias("VScore"),
    )
    out = harmonise.normalise_events(raw)
    return out.select("game_id", "home", "away", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("utc"), "home_score", "away_score", "row_order")


EVENT_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS game_id, 'T' || (l_orderkey % 30) AS home, 'T99' AS away, strftime(l_shipdate - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS utc,
  CAST(NULL AS DOUBLE) AS home_score, CAST(l_linenumber AS DOUBLE) AS away_score,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST((l_linenumber::BIGINT * 100000000 + l_partkey) * 100000 + l_suppkey AS DOUBLE), l_shipdate) - 1 AS row_order
FROM lineitem WHERE l_orderkey % 50 <> 0"""


def shot_efficiency(spark, d):
    g = adapters.matches(spark, d).withColumns(
        {"shots_home": F.col("game_id") % 13, "shots_away": F.col("game_id") % 7, "sot_home": F.col("game_id") % 5, "sot_away": F.col("game_id") % 3}
    )
    out = harmonise.shot_efficiency(g).withColumn("pct", harmonise.percent(F.col("shot_accuracy_home")))
    return rounded(out, ["game_id"], ["shot_conversion_home", "shot_accuracy_home", "shot_conversion_away", "shot_accuracy_away", "pct"])


SHOT_SQL = with_views(
    "SELECT game_id, " + ", ".join(
        _r(e, n) for n, e in {
            "shot_conversion_home": "home_score / NULLIF(game_id % 13, 0)", "shot_accuracy_home": "(game_id % 5) / NULLIF(game_id % 13, 0)",
            "shot_conversion_away": "away_score / NULLIF(game_id % 7, 0)", "shot_accuracy_away": "(game_id % 3) / NULLIF(game_id % 7, 0)",
            "pct": "round((game_id % 5) / NULLIF(game_id % 13, 0) * 100, 2)",
        }.items()
    ) + " FROM matches"
)


def side_resolution(spark, d):
    g = adapters.matches(spark, d)
    named = F.when(F.col("game_id") % 3 == 0, F.substring("home", 1, 4)).when(F.col("game_id") % 3 == 1, F.concat(F.col("away"), F.lit(" club"))).otherwise("none")
    side = F.when(text.contained(named, F.col("home")), "home").when(text.contained(named, F.col("away")), "away")
    return g.select("game_id", side.alias("side"))


SIDE_SQL = with_views(
    """, n AS (SELECT *, CASE game_id % 3 WHEN 0 THEN substring(home, 1, 4) WHEN 1 THEN away || ' club' ELSE 'none' END AS x FROM matches)
    SELECT game_id, CASE WHEN contains(x, home) OR contains(home, x) THEN 'home' WHEN contains(x, away) OR contains(away, x) THEN 'away' END AS side FROM n"""
)


# ---- joins ---------------------------------------------------------------------------------------


def settlement_join(spark, d):
    g = adapters.matches(spark, d)
    ledger = g.select(
        "game_id", (F.col("datetime").cast("timestamp") + F.expr("INTERVAL 9 HOURS")).alias("datetime"), "home", "away",
        F.when(F.col("game_id") % 6 == 0, F.lit(1).cast("long")).alias("actual"), F.lit(None).cast("long").alias("actual_home_score"), F.lit(None).cast("long").alias("actual_away_score"),
    )
    # One official result per local date and fixture: the lowest game id speaks for repeats.
    official = g.filter("game_id % 4 <> 0").groupBy(F.to_date("datetime").alias("date"), "home", "away").agg(
        F.min_by("home_score", "game_id").alias("home_score"), F.min_by("away_score", "game_id").alias("away_score")
    )
    return joins.settle(ledger, official, F.lit("2000-01-10 12:00:00").cast("timestamp")).drop("datetime")


SETTLE_SQL = with_views(
    """, off AS (SELECT CAST(datetime AS DATE) AS d, home, away, arg_min(home_score, game_id) AS hs, arg_min(away_score, game_id) AS vs FROM matches WHERE game_id % 4 <> 0 GROUP BY 1, 2, 3),
    l AS (SELECT m.game_id, m.home, m.away, CASE WHEN m.game_id % 6 = 0 THEN 1 END AS act, o.hs, o.vs,
      m.game_id % 6 <> 0 AND o.hs IS NOT NULL AND (CAST(m.datetime + INTERVAL 18 HOUR AS DATE) < DATE '2000-01-10'
        OR (CAST(m.datetime + INTERVAL 18 HOUR AS DATE) = DATE '2000-01-10' AND m.datetime + INTERVAL 9 HOUR <= TIMESTAMP '2000-01-10 07:00:00')) AS hit
      FROM matches m LEFT JOIN off o ON o.d = CAST(m.datetime + INTERVAL 18 HOUR AS DATE) AND o.home = m.home AND o.away = m.away)
    SELECT game_id, home, away, CAST(CASE WHEN hit THEN CASE WHEN hs > vs THEN 0 WHEN hs = vs THEN 1 ELSE 2 END ELSE act END AS BIGINT) AS actual,
      CASE WHEN hit THEN hs END AS actual_home_score, CASE WHEN hit THEN vs END AS actual_away_score, hit AS settled_now FROM l"""
)


def hourly_join(spark, d):
    o = adapters.observations(spark, d).withColumn("venue", F.col("game_id") % 12)
    readings = o.filter("kind = 'WEATHER'").groupBy("venue", F.date_trunc("hour", "available_at").alias("hour")).agg(F.max("reading").alias("temp"))
    out = joins.hourly(o.filter("kind <> 'WEATHER'"), readings, "venue", "available_at")
    return out.select("event_id", "venue", F.round("temp", 6).alias("temp"))


HOURLY_SQL = with_views(
    """, o AS (SELECT *, game_id % 12 AS venue, date_trunc('hour', available_at) AS hh FROM observations), w AS (SELECT venue, hh, max(reading) AS temp FROM o WHERE kind = 'WEATHER' GROUP BY 1, 2)
    SELECT event_id, o.venue, ROUND(temp, 6) AS temp FROM o LEFT JOIN w ON w.venue = o.venue AND w.hh = o.hh WHERE kind <> 'WEATHER'"""
)


def nearest_hour_join(spark, d):
    o = adapters.observations(spark, d).withColumns({"venue": F.col("game_id") % 12, "t": F.unix_micros("available_at")})
    readings = o.filter("kind = 'WEATHER'").select("venue", F.col("t").alias("at"), F.col("reading").alias("temp"))
    out = joins.nearest(o.filter("kind <> 'WEATHER'").select("event_id", "venue", "t"), readings, ["venue"], "event_id", "t", "at", ["temp"], 6 * 3_600_000_000)
    return out.select("event_id", "at", F.round("temp", 6).alias("temp"), "quality")


NEAREST_SQL = with_views(
    """, o AS (SELECT *, game_id % 12 AS venue, epoch_us(available_at) AS t FROM observations), w AS (SELECT venue, t AS at, max(reading) AS temp FROM o WHERE kind = 'WEATHER' GROUP BY 1, 2),
    j AS (SELECT event_id, w.at, w.temp, row_number() OVER (PARTITION BY event_id ORDER BY abs(w.at - o.t), w.at) AS rn FROM o JOIN w ON w.venue = o.venue AND abs(w.at - o.t) <= 21600000000 WHERE kind <> 'WEATHER')
    SELECT o.event_id, j.at, ROUND(j.temp, 6) AS temp, CASE WHEN j.at IS NULL THEN 'UNKNOWN' WHEN j.at = o.t THEN 'EXACT' ELSE 'NEAREST' END AS quality
    FROM o LEFT JOIN j ON j.event_id = o.event_id AND rn = 1 WHERE kind <> 'WEATHER'"""
)


def _snapshots(spark, d):
    return adapters.observations(spark, d).groupBy("game_id", "prediction_time").agg(
        F.max("event_id").alias("snapshot_id"), F.count(F.lit(1)).alias("observations"), F.max("value").alias("value")
    )


SNAP_SQL = ", snap AS (SELECT game_id, prediction_time, max(event_id) AS snapshot_id, count(*) AS observations, max(value) AS value FROM observations GROUP BY 1, 2)"


def asof_snapshot(spark, d):
    asks = adapters.observations(spark, d).filter("kind = 'REST_TRAVEL'").select("event_id", "game_id", (F.col("available_at") - F.expr("INTERVAL 90 MINUTES")).alias("cutoff"))
    out = joins.as_of(asks, _snapshots(spark, d), ["game_id"], "cutoff", "prediction_time", ["snapshot_id", "value"], "snapshot_id")
    return out.select("event_id", "game_id", "snapshot_id", "value")


ASOF_SQL = with_views(
    SNAP_SQL + """, a AS (SELECT event_id, game_id, available_at - INTERVAL 90 MINUTE AS cutoff FROM observations WHERE kind = 'REST_TRAVEL')
    SELECT a.event_id, a.game_id, s.snapshot_id, s.value FROM a ASOF LEFT JOIN snap s ON a.game_id = s.game_id AND a.cutoff >= s.prediction_time"""
)


def canonical_snapshot(spark, d):
    final = joins.canonical_snapshots(_snapshots(spark, d))
    settled = adapters.predictions(spark, d).select("game_id", "actual")
    return final.join(settled, "game_id").select("game_id", "snapshot_id", "observations", "actual")


CANONICAL_SQL = with_views(
    SNAP_SQL + """ SELECT s.game_id, arg_max(s.snapshot_id, s.prediction_time) AS snapshot_id, arg_max(s.observations, s.prediction_time) AS observations, any_value(p.actual) AS actual
    FROM snap s JOIN predictions p ON p.game_id = s.game_id GROUP BY 1"""
)


def prior_snapshot(spark, d):
    line = Timeline(_snapshots(spark, d), ["game_id"], ["prediction_time"])
    return line.last_seen({"prior_id": F.col("snapshot_id")}).select("game_id", "snapshot_id", "prior_id")


PRIOR_SQL = with_views(SNAP_SQL + " SELECT game_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY game_id ORDER BY prediction_time) AS prior_id FROM snap")


def reconcile_full_outer(spark, d):
    p = T(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("event_id")).filter("event_id % 10 <> 1")
    r = T(spark, d, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("event_id")).distinct()
    return joins.reconcile(p, r)


RECONCILE_SQL = """WITH p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 1), r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
 c AS (SELECT count(p.k) AS prediction_rows, count(r.k) AS result_rows, count(*) FILTER (WHERE p.k IS NOT NULL AND r.k IS NOT NULL) AS matched_rows,
   count(*) FILTER (WHERE r.k IS NULL) AS unmatched_predictions, count(*) FILTER (WHERE p.k IS NULL) AS unmatched_results FROM p FULL JOIN r ON p.k = r.k)
SELECT *, CAST(0 AS BIGINT) AS duplicated_keys, 'PASS' AS status FROM c"""


def two_source_validation(spark, d):
    g = adapters.matches(spark, d)
    official = g.filter("game_id % 5 <> 0").withColumn("home_score", F.when(F.col("game_id") % 997 == 0, F.col("home_score") + 1).otherwise(F.col("home_score")))
    return joins.two_source(g, official, ["game_id", "datetime", "home", "away"])


TWO_SQL = with_views(
    """, c AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE game_id % 5 <> 0) AS admitted, count(*) FILTER (WHERE game_id % 5 <> 0 AND game_id % 997 = 0) AS mismatched FROM matches)
    SELECT *, CASE WHEN mismatched > 0 OR admitted = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c"""
)


def starter_repair(spark, d):
    g = adapters.matches(spark, d).select("game_id", "datetime", F.when(F.col("game_id") % 3 == 0, " ").otherwise("known").alias("home_starter"))
    fixes = g.filter("game_id % 2 = 0").select("game_id", F.concat(F.lit("fix"), F.col("game_id").cast("string")).alias("home_starter"))
    out = joins.repair(g, fixes, "game_id", ["home_starter"], F.col("datetime") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return out.select("game_id", "home_starter")


REPAIR_SQL = with_views(
    """SELECT game_id, CASE WHEN game_id % 3 <> 0 THEN 'known' WHEN game_id % 2 = 0 AND datetime >= TIMESTAMP '1999-01-01' THEN 'fix' || game_id ELSE '' END AS home_starter FROM matches"""
)


def coverage_upsert(spark, d):
    g = adapters.matches(spark, d).withColumn("year", F.year("datetime"))
    old = g.groupBy("year").agg(F.count(F.lit(1)).alias("games"))
    new = g.filter("training_included and year >= 1999").groupBy("year").agg(F.count(F.lit(1)).alias("games"))
    return joins.upsert(old, new, ["year"])


UPSERT_SQL = with_views(
    """SELECT CAST(year(datetime) AS INT) AS year, CASE WHEN year(datetime) >= 1999 THEN count(*) FILTER (WHERE training_included) ELSE count(*) END AS games FROM matches GROUP BY 1, year(datetime)"""
)


def roster_notices(spark, d):
    s = T(spark, d, "supplier", "s_suppkey", "s_nationkey").join(T(spark, d, "nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    notices = s.groupBy(F.col("n_name").alias("team")).agg(F.count(F.lit(1)).alias("notices"))
    out = joins.notices_for_games(adapters.matches(spark, d), notices)
    return out.groupBy("game_id").agg(F.sum("notices").alias("notices"))


ROSTER_SQL = with_views(
    """, n AS (SELECT n_name AS team, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), s AS (SELECT game_id, home AS team FROM matches UNION ALL SELECT game_id, away FROM matches)
    SELECT game_id, CAST(sum(c) AS BIGINT) AS notices FROM s JOIN n ON n.team = s.team GROUP BY game_id"""
)


def exact_equality(spark, d):
    a = T(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey")
    b = a.filter("o_orderkey % 1000 <> 7").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return joins.frame_equality(a, b, "o_orderkey", ["o_totalprice", "o_custkey"])


EQUALITY_SQL = """SELECT count(*) AS left_rows, count(*) FILTER (WHERE o_orderkey % 1000 <> 7) AS right_rows, CAST(0 AS BIGINT) AS duplicated_keys,
 count(*) FILTER (WHERE o_orderkey % 1000 = 7) AS unpaired_keys, count(*) FILTER (WHERE o_orderkey % 500 = 3 AND o_orderkey % 1000 <> 7) AS differing_cells, true AS schema_equal, false AS equal FROM orders"""


def lineup_join(spark, d):
    """Lineups parsed from JSON, joined to batter profiles as of each game."""
    lines = adapters.player_games(spark, d)
    games = adapters.matches(spark, d).select("game_id", "league", "datetime", F.col("training_included").alias("eligible"))
    prof = form.player_profiles(lines.join(games, "game_id"))
    # The lineup text of a game: its first twelve players in batting order.
    ordered = lines.select(
        "game_id", F.col("player_id").cast("string").alias("player_id"), (F.col("player_id") % 9).cast("double").alias("batting_order")
    )
    ordered = Timeline(ordered, ["game_id"], ["batting_order", "player_id"]).positions().filter("pos <= 12")
    js = ordered.groupBy("game_id").agg(F.to_json(F.collect_list(F.struct("player_id", "batting_order"))).alias("lineup_json"))
    lineup = js.select("game_id", F.lit("home").alias("side"), F.explode(joins.lineup_array(F.col("lineup_json"))).alias("x"))
    lineup = lineup.select("game_id", "side", F.col("x.player_id").cast("long").alias("player_id"))
    out = joins.lineup_features(lineup, prof, games.select("game_id", F.lit("home").alias("side")))
    return rounded(out, ["game_id"], [f"lineup_{c}" for c in (*joins.LINEUP_NEUTRAL, *joins.LINEUP_SUMS, "n", "known_n", "history_coverage")])


def _lineup_sql():
    from matchloom.suite.history import _player_sql

    counted = ("avg", "obp", "slg", "iso", "bb_rate", "so_rate")
    more = [m for m in joins.LINEUP_NEUTRAL if m not in counted and not m.startswith("recent_")]
    inner = _player_sql(more, ("pa", "iso", "so_rate", "bb_rate", "sb_rate"))
    head, tail = inner.rsplit("SELECT s.game_id, s.player_id", 1)
    wt = "exp((i - len(xs)) / 12.0E0)"
    pa = f"COALESCE(list_sum(list_transform(xs, lambda r, i: r.pa * {wt})) / list_sum(list_transform(xs, lambda r, i: {wt})), 0)"
    # Profiles are recomputed unrounded for the weights.
    raw = "SELECT s.game_id, s.player_id" + tail
    raw = raw.replace("ROUND(CAST(", "((").replace(" AS DOUBLE) + 1e-9, 6)", "))")
    w = "GREATEST(pp_pa, 1)"
    out = ", ".join(_r(f"COALESCE(sum(pp_{m} * {w}) / sum(CASE WHEN pp_{m} IS NOT NULL THEN {w} END), {v})", f"lineup_{m}") for m, v in joins.LINEUP_NEUTRAL.items())
    sums = ", ".join(_r(f"COALESCE(sum(pp_{m}), 0)", f"lineup_{name}") for name, m in joins.LINEUP_SUMS.items())
    known = "count(*) FILTER (WHERE pp_games > 0)"
    return (
        head + f", prof AS ({raw.replace('SELECT s.game_id, s.player_id,', f'SELECT s.game_id, s.player_id, {pa} AS pp_pa,', 1)}), "
        "ln AS (SELECT game_id, player_id, row_number() OVER (PARTITION BY game_id ORDER BY player_id % 9, CAST(player_id AS VARCHAR)) AS rn FROM player_games) "
        f"SELECT m.game_id, {out}, {sums}, {_r('count(ln.player_id)', 'lineup_n')}, {_r(known, 'lineup_known_n')}, {_r(f'{known} / GREATEST(count(ln.player_id), 1)', 'lineup_history_coverage')} "
        "FROM matches m LEFT JOIN ln ON ln.game_id = m.game_id AND rn <= 12 LEFT JOIN prof p ON p.game_id = ln.game_id AND p.player_id = ln.player_id GROUP BY m.game_id"
    )


def enriched_game(spark, d):
    """Schedule with starters and team batting; target-game values keep an observed_ prefix, pre-game ones stay blank."""
    from matchloom.operators import reports
    from matchloom.suite.reports import first_pitcher

    g = adapters.matches(spark, d)
    lines = adapters.player_games(spark, d).withColumn("side", F.when(F.col("player_id") % 2 == 0, "home").otherwise("away"))
    bat = reports.team_batting(lines, ["ab", "h"])
    wide = bat.groupBy("game_id").agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"observed_{s}_bat_{c}") for s in ("home", "away") for c in ("ab", "h")]
    )
    starters = first_pitcher(spark, d).select("game_id", F.col("home_starter").alias("observed_home_starter"), F.col("away_starter").alias("observed_away_starter"))
    out = g.join(starters, "game_id", "left").join(wide, "game_id", "left")
    return out.select(
        "game_id", "home", "away", *[c for c in out.columns if c.startswith("observed_")], F.lit("").alias("home_pregame_starter"), F.lit("UNKNOWN").alias("starter_state")
    )


def _enriched_sql():
    from matchloom.suite.history import PLAYER_SQL
    from matchloom.suite.reports import FIRST_SQL

    bat = ", ".join(f"CAST(sum({c}) FILTER (WHERE player_id % 2 = {0 if s == 'home' else 1}) AS BIGINT) AS observed_{s}_bat_{c}" for s in ("home", "away") for c in ("ab", "h"))
    return with_views(
        f""", {PLAYER_SQL}, b AS (SELECT game_id, {bat} FROM player_games GROUP BY 1), f AS ({FIRST_SQL})
        SELECT m.game_id, m.home, m.away, f.home_starter AS observed_home_starter, f.away_starter AS observed_away_starter, b.* EXCLUDE (game_id), '' AS home_pregame_starter, 'UNKNOWN' AS starter_state
        FROM matches m LEFT JOIN f ON f.game_id = m.game_id LEFT JOIN b ON b.game_id = m.game_id"""
    )


# ---- sets, merges, completeness -----------------------------------------------------------------


def dedup_latest(spark, d):
    li = T(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    out = latest_per_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


DEDUP_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1"""


def schema_union(spark, d):
    g = adapters.matches(spark, d)
    a = g.filter("league = 'ASIA'").select("game_id", "home", F.lit("pbp").alias("source"))
    b = g.filter("league <> 'ASIA'").select("game_id", "venue", F.lit("schedule").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


UNION_SQL = with_views(
    """SELECT game_id, home, 'pbp' AS source, CAST(NULL AS VARCHAR) AS venue FROM matches WHERE league = 'ASIA' UNION ALL BY NAME SELECT game_id, CAST(NULL AS VARCHAR) AS home, 'schedule' AS source, venue FROM matches WHERE league <> 'ASIA'"""
)


def plan_coverage(spark, d):
    wanted = T(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "unit")
    delivered = T(spark, d, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "unit")
    return joins.coverage_check(wanted, delivered, "unit")


PLAN_SQL = """WITH dl AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey AS w, dl.k, dl.n FROM orders FULL JOIN dl ON dl.k = o_orderkey),
c AS (SELECT count(*) FILTER (WHERE k IS NULL) AS missing, count(*) FILTER (WHERE w IS NULL) AS unexpected, count(*) FILTER (WHERE n > 1) AS duplicated FROM j)
SELECT *, missing + unexpected + duplicated = 0 AS complete FROM c"""


def key_sets(spark, d):
    o = T(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("k"))
    li = T(spark, d, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("k"))
    part = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(n))
    return part(o.intersect(li), "both").unionByName(part(o.subtract(li), "left_only")).unionByName(part(li.exceptAll(o), "right_repeats"))


KEY_SQL = """SELECT 'both' AS part, count(*) AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'left_only', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'right_repeats', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)"""


def shard_merge(spark, d):
    g = adapters.matches(spark, d)
    shards = [g.filter(F.pmod(F.hash("game_id"), F.lit(4)) == i) for i in range(4)]
    merged = shards[0].unionAll(shards[1]).unionAll(shards[2]).unionAll(shards[3])
    return joins.coverage_check(g.select("game_id"), merged.select("game_id"), "game_id")


SHARD_SQL = "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected, CAST(0 AS BIGINT) AS duplicated, true AS complete FROM (SELECT count(*) FROM orders)"


def delta_merge(spark, d):
    g = adapters.matches(spark, d).select("game_id", "datetime", "home_score", "away_score")
    base = g.filter(F.col("datetime") < F.lit("2000-01-01").cast("timestamp_ntz"))
    cut = store.delta_cutoff(base, "datetime", F.lit("1999-03-01").cast("timestamp_ntz"))
    delta = g.filter(F.col("datetime") >= cut).withColumn("home_score", F.col("home_score") + 100)
    kept, year = store.TableStore(spark, fresh_path(spark, "store")), F.year("datetime")
    for part in (base, delta):
        store.merge_into(kept, "silver", "games", part.withColumn("season", year), ["game_id"], ["datetime"], "season")
    return kept.read("silver", "games").select("game_id", "home_score", "away_score")


DELTA_SQL = with_views(
    """, c AS (SELECT GREATEST(TIMESTAMP '1999-03-01', max(datetime) - INTERVAL 7 DAY) AS cut FROM matches WHERE datetime < TIMESTAMP '2000-01-01')
    SELECT game_id, home_score + CASE WHEN datetime >= cut THEN 100 ELSE 0 END AS home_score, away_score FROM matches, c"""
)


def snapshot_quarantine(spark, d):
    """Observations written as snapshot lines, some of them broken, without a game or of an old version; both sides counted."""
    o = adapters.observations(spark, d)
    stamp = F.date_format("prediction_time", "yyyy-MM-dd HH:mm:ss")
    game = F.when(F.col("event_id") % 11 != 3, F.col("game_id").cast("string"))
    line = F.to_json(F.struct(game.alias("game_id"), stamp.alias("prediction_time_utc"), F.array(F.struct("kind", "state", "value")).alias("observations"), F.when(F.col("event_id") % 13 == 5, 2).alias("schema_version")))
    source, sink = fresh_path(spark, "lines"), fresh_path(spark, "quarantine")
    o.select(F.when(F.col("event_id") % 7 == 2, F.substring_index(line, "}]", 1)).otherwise(line).alias("value")).write.text(source)
    good = readers.snapshots_or_quarantine(spark, source, sink)
    kept = readers.observations_of(good).groupBy(F.lit("GOOD").alias("reason")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("kind").alias("kinds"))
    bad = spark.read.parquet(sink).filter("file is not null and content is not null")
    return kept.unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.lit(None).cast("long").alias("kinds")))


QUARANTINE_SQL = with_views(
    """, l AS (SELECT kind, CASE WHEN event_id % 7 = 2 THEN 'CORRUPT' WHEN event_id % 11 = 3 THEN 'INCOMPLETE' WHEN event_id % 13 = 5 THEN 'STALE' ELSE 'GOOD' END AS reason FROM observations)
    SELECT reason, count(*) AS lines, CASE WHEN reason = 'GOOD' THEN count(DISTINCT kind) END AS kinds FROM l GROUP BY reason"""
)


def chunk_completeness(spark, d):
    o = T(spark, d, "orders", "o_orderkey", "o_orderdate")
    week = F.date_add(F.lit("1995-01-01").cast("date"), (F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) / 7) * 7).cast("int"))
    landed = o.groupBy(week.alias("chunk_start")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_orderkey") % 3).alias("bytes"), (F.max("o_orderkey") % 2 + 1).alias("schema_version"))
    landed = landed.filter(F.weekofyear("chunk_start") % 9 != 0)
    expected = store.expected_chunks(spark, "1995-01-01", "2001-12-31", 7)
    out = store.chunk_completeness(expected, landed, 2)
    return out.select(F.date_format("chunk_start", "yyyy-MM-dd").alias("chunk_start"), F.date_format("chunk_end", "yyyy-MM-dd").alias("chunk_end"), "state")


CHUNK_SQL = """WITH e AS (SELECT CAST(r AS DATE) AS s FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 7 DAY) t(r)),
 l AS (SELECT DATE '1995-01-01' + CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7 * 7 AS INT) AS s, sum(o_orderkey % 3) AS b, max(o_orderkey) % 2 + 1 AS v FROM orders GROUP BY 1)
SELECT strftime(e.s, '%Y-%m-%d') AS chunk_start, strftime(LEAST(e.s + 6, DATE '2001-12-31'), '%Y-%m-%d') AS chunk_end,
  CASE WHEN l.b IS NULL OR weekofyear(e.s) % 9 = 0 THEN 'MISSING' WHEN l.b = 0 OR l.v <> 2 THEN 'RELOAD' ELSE 'DONE' END AS state FROM e LEFT JOIN l ON l.s = e.s"""


def resume_selection(spark, d):
    wanted = T(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("game_id"))
    done = T(spark, d, "lineitem", "l_orderkey", "l_returnflag").select(F.col("l_orderkey").alias("game_id"), F.col("l_returnflag").alias("version"))
    return store.remaining(wanted, done, ["game_id"], "A")


RESUME_SQL = "SELECT o_orderkey AS game_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')"


def material_change(spark, d):
    now = T(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").withColumn("seen_at", F.rand(7))
    old = T(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").filter("c_custkey % 10 <> 0").withColumn("seen_at", F.rand(8))
    old = old.withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "renamed").otherwise(F.col("c_name")))
    return store.changed_rows(now, old, "c_custkey", ["seen_at"]).select("c_custkey")


CHANGE_SQL = "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0"


def boxscore_starter(spark, d):
    li = T(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linestatus", "l_quantity", "l_partkey")
    players = li.select(
        F.col("l_orderkey").alias("game_id"), F.when(F.col("l_linestatus") == "O", "home").otherwise("away").alias("side"), F.col("l_suppkey").cast("string").alias("name"),
        F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("games_started"), (F.col("l_partkey") % 4 == 0).alias("is_starting_pitcher"),
    )
    return readers.boxscore_starters(players)


BOX_SQL = """WITH p AS (SELECT l_orderkey AS game_id, CASE WHEN l_linestatus = 'O' THEN 'home' ELSE 'away' END AS side, CAST(l_suppkey AS VARCHAR) AS name,
  CASE WHEN l_quantity > 40 THEN 0 WHEN l_partkey % 4 = 0 THEN 1 END AS rk FROM lineitem)
SELECT game_id, side, COALESCE(min(name) FILTER (WHERE rk = m), '') AS starter FROM (SELECT *, min(rk) OVER (PARTITION BY game_id, side) AS m FROM p) GROUP BY 1, 2"""


def text_lines(spark, d):
    """Documents as non-blank raw lines."""
    docs = T(spark, d, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("raw_line")).filter(F.trim("raw_line") != "")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("raw_line")).alias("chars"))


LINES_SQL = """SELECT doc_id, count(*) AS lines, CAST(sum(length(l)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, ' ') <> '' GROUP BY doc_id"""

QUERIES = {
    "outcome_label": outcome_label, "dense_unpivot": team_unpivot, "taxonomy_classify": taxonomy_classify, "category_override": category_override,
    "safe_parse": safe_parse, "local_time": local_time, "pit_usable": pit_usable, "market_line": market_line, "forecast_gate": forecast_gate,
    "event_normalise": event_normalise, "shot_efficiency": shot_efficiency, "side_resolution": side_resolution, "settlement_join": settlement_join,
    "hourly_join": hourly_join, "nearest_hour_join": nearest_hour_join, "asof_snapshot": asof_snapshot, "canonical_snapshot": canonical_snapshot,
    "prior_snapshot": prior_snapshot, "reconcile_full_outer": reconcile_full_outer, "two_source_validation": two_source_validation,
    "starter_repair": starter_repair, "coverage_upsert": coverage_upsert, "roster_notices": roster_notices, "exact_equality": exact_equality,
    "lineup_join": lineup_join, "enriched_game": enriched_game, "dedup_latest": dedup_latest, "schema_union": schema_union, "plan_coverage": plan_coverage,
    "key_sets": key_sets, "shard_merge": shard_merge, "delta_merge": delta_merge, "snapshot_quarantine": snapshot_quarantine, "chunk_completeness": chunk_completeness,
    "resume_selection": resume_selection, "material_change": material_change, "boxscore_starter": boxscore_starter, "text_lines": text_lines,
}
ORACLES = {
    "outcome_label": with_views(
        """SELECT game_id, CAST(CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS BIGINT) AS three_way,
        CAST(CASE WHEN home_score > away_score THEN 0 ELSE 1 END AS BIGINT) AS two_way, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS letter FROM matches"""
    ),
    "dense_unpivot": with_views(
        """SELECT league, team, count(*) AS games, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, count(*) FILTER (WHERE is_home) AS home_games, count(*) FILTER (WHERE gf > ga) AS wins FROM team_rows GROUP BY 1, 2"""
    ),
    "taxonomy_classify": TAXONOMY_SQL, "category_override": _override_sql(), "safe_parse": SAFE_SQL, "local_time": LOCAL_SQL, "pit_usable": PIT_SQL,
    "market_line": MARKET_SQL, "forecast_gate": GATE_SQL, "event_normalise": EVENT_SQL, "shot_efficiency": SHOT_SQL, "side_resolution": SIDE_SQL,
    "settlement_join": SETTLE_SQL, "hourly_join": HOURLY_SQL, "nearest_hour_join": NEAREST_SQL, "asof_snapshot": ASOF_SQL, "canonical_snapshot": CANONICAL_SQL,
    "prior_snapshot": PRIOR_SQL, "reconcile_full_outer": RECONCILE_SQL, "two_source_validation": TWO_SQL, "starter_repair": REPAIR_SQL,
    "coverage_upsert": UPSERT_SQL, "roster_notices": ROSTER_SQL, "exact_equality": EQUALITY_SQL, "lineup_join": _lineup_sql(), "enriched_game": _enriched_sql(),
    "dedup_latest": DEDUP_SQL, "schema_union": UNION_SQL, "plan_coverage": PLAN_SQL, "key_sets": KEY_SQL, "shard_merge": SHARD_SQL, "delta_merge": DELTA_SQL, "snapshot_quarantine": QUARANTINE_SQL,
    "chunk_completeness": CHUNK_SQL, "resume_selection": RESUME_SQL, "material_change": CHANGE_SQL, "boxscore_starter": BOX_SQL, "text_lines": LINES_SQL,
}
