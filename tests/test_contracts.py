"""Harmonisation, contracts, readers, gates and streams on small frames."""

import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from matchloom.functions import dist, prob, text
from matchloom.operators import calibrate, context, form, harmonise, joins, reports, scorelines, stages
from matchloom.sources import readers, store
from matchloom.streaming import held, live


def one(df):
    return df.first()


def test_taxonomy_and_policy(spark):
    df = spark.createDataFrame([("セ・リーグ公式戦",), ("交流戦",), ("クライマックスシリーズ",), ("オープン戦",), ("All-Star  Game",), ("",), (None,)], "game_type string")
    got = [r.category for r in harmonise.classify(df).select("category").collect()]
    assert got == ["regular", "interleague", "climax", "excluded", "allstar", "unknown", "unknown"]
    assert harmonise.policy_set(" Regular, climax ,regular", ("x",)) == ("regular", "climax") and harmonise.policy_set(" ", ("x",)) == ("x",)


def test_pit_fails_closed(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:00:00", "2024-01-01 01:00:00", "VERIFIED"), ("2024-01-01 02:00:00", "2024-01-01 01:00:00", "VERIFIED"), (None, "2024-01-01 01:00:00", "VERIFIED"),
         ("2024-01-01 00:00:00", None, "VERIFIED"), ("2024-01-01 00:00:00", "2024-01-01 01:00:00", "STALE"), ("2024-01-01 00:00:00", "2024-01-01 01:00:00", None)],
        "a string, c string, s string",
    ).selectExpr("cast(a as timestamp) a", "cast(c as timestamp) c", "s")
    assert [r.ok for r in df.select(harmonise.pit_usable(F.col("a"), F.col("c"), F.col("s")).alias("ok")).collect()] == [True, False, False, False, False, False]


def test_candidates_match_full_grid(spark):
    import math

    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.4, 0.3), (3, 9.0, 8.0), (4, 2.5, 2.5)], "game_id long, lambda_home double, lambda_away double")
    pm = lambda k, l: math.exp(-l + k * math.log(l) - math.lgamma(k + 1))
    for mode, (top, other, renorm) in scorelines.CANDIDATE_MODES.items():
        for r in scorelines.score_candidates(df, n=4, mode=mode).collect():
            cells = [(h, a, pm(h, r.lambda_home) * pm(a, r.lambda_away)) for h in range(top + 1) for a in range(top + 1)]
            mass = sum(c[2] for c in cells)
            cells = [(h, a, p / (mass if renorm else 1.0)) for h, a, p in cells] + ([(999, 999, 1 - mass)] if other else [])
            best = sorted(cells, key=lambda c: (-round(c[2], 12), c[0], c[1]))[:4]
            want = ["OTHER" if h == 999 else f"{h}-{a}" for h, a, _ in best]
            assert [c.label for c in r.candidates] == want


def test_low_high_and_line(spark):
    df = spark.createDataFrame([(3.0, 3.5, 6.5), (3.0, 3.5, 7.0), (3.0, 3.5, None)], "h double, a double, line double")
    got = df.select(dist.low_total(F.col("h"), F.col("a")).alias("low"), dist.line_probs(F.col("h"), F.col("a"), F.col("line")).alias("x")).collect()
    assert got[0].x.low == pytest.approx(got[0].low) and got[0].x.low + got[0].x.high == pytest.approx(1.0)
    assert got[1].x is None and got[2].x is None


def test_clip_prob_and_ece(spark):
    df = spark.createDataFrame([([float("nan"), 0.5, float("inf")],)], "p array<double>")
    assert sum(one(df.select(prob.clip_prob(F.col("p")).alias("q"))).q) == pytest.approx(1.0)
    sure = spark.createDataFrame([([1.0, 0.0, 0.0], 0), ([0.0, 1.0, 0.0], 1)], "p array<double>, actual int")
    assert one(reports.metric_bundle(sure, [])).ece == pytest.approx(0.0, abs=1e-9)


def test_reconcile_and_integrity(spark):
    p = spark.createDataFrame([(1,), (2,), (2,)], "event_id long")
    r = spark.createDataFrame([(2,), (3,)], "event_id long")
    row = one(joins.reconcile(p, r))
    assert (row.matched_rows, row.unmatched_predictions, row.unmatched_results, row.status) == (1, 1, 1, "FAIL")
    two = spark.createDataFrame([(1, 0.4, 0.6), (2, 0.5, 0.5)], "event_id long, a double, b double")
    assert one(reports.probability_integrity(two, ["a", "b"], "event_id")).status == "PASS"


def test_rest_travel_strictly_before(spark):
    g = spark.createDataFrame(
        [("L", 1, "2024-01-01 00:00:00", "a", "b", 1, 2, "v1"), ("L", 2, "2024-01-02 00:00:00", "a", "c", 1, 2, "v2"), ("L", 3, "2024-01-02 00:00:00", "a", "d", 1, 2, "v2")],
        "league string, game_id long, datetime string, home string, away string, home_score int, away_score int, venue string",
    ).withColumn("datetime", F.col("datetime").cast("timestamp"))
    rows = form.team_rows(g).join(g.select("game_id", "venue"), "game_id")
    places = spark.createDataFrame([("v1", 35.0, 139.0), ("v2", 34.0, 135.0)], "venue string, lat double, lon double")
    got = {(r.game_id, r.team): r for r in scorelines.rest_travel(rows, places).collect()}
    assert got[(1, "a")].state == "UNKNOWN" and got[(3, "a")].games_3d == 1 and got[(3, "a")].rest_days == 1.0 and got[(2, "a")].travel_miles > 200


def test_change_rules_and_cancelling(spark):
    o = spark.createDataFrame(
        [(1, 7, "2024-01-01 00:00:00", "2024-01-01 01:00:00", "AVAILABILITY", "VERIFIED", "PLAYER_OUT"), (2, 7, "2024-01-01 01:30:00", "2024-01-01 02:00:00", "AVAILABILITY", "VERIFIED", "PLAYER_RETURNED"),
         (3, 7, "2024-01-01 05:00:00", "2024-01-01 03:00:00", "STARTER", "VERIFIED", "late")],
        "event_id long, game_id long, a string, p string, kind string, state string, value string",
    ).selectExpr("event_id", "game_id", "cast(a as timestamp) available_at", "cast(p as timestamp) prediction_time", "kind", "state", "value")
    ev = context.delta_events(o)
    assert sorted(r.event for r in ev.collect()) == ["PLAYER_OUT", "PLAYER_RETURNED"]
    assert [r.event for r in context.cumulative_events(ev).collect()] == ["PLAYER_RETURNED"]


def test_policy_identity_and_bounds(spark):
    df = spark.createDataFrame([(1, [0.5, 0.2, 0.3], [("ctx_X", "VERIFIED", 1.0)]), (2, [0.5, 0.2, 0.3], [("ctx_X", "UNKNOWN", 1.0)])], "game_id long, p array<double>, contexts array<struct<key:string,state:string,confidence:double>>")
    pol = spark.createDataFrame([("ctx_X", 0, 9.0, 0.15)], "key string, class_index long, coef double, cap double")
    got = {r.game_id: r for r in context.apply_policy(df, pol).collect()}
    assert got[1].shift[0] == pytest.approx(0.15) and got[1].decided[0] > 0.5 and got[2].decided == pytest.approx([0.5, 0.2, 0.3])
    assert one(context.apply_policy(df, pol, eligible=False)).decided == pytest.approx([0.5, 0.2, 0.3])
    two = df.withColumn("p", F.array(F.lit(0.6), F.lit(0.4)))
    assert 0.6 < one(context.apply_policy(two, pol, classes=2).filter("game_id = 1")).decided[0] < 0.7


def test_game_aggregate_scores(spark):
    ev = spark.createDataFrame(
        [("g", 2, "H", "A", "2024-01-01", None, None, "top", "1", "2", "", "q", "公式戦"), ("g", 1, "H", "A", "2024-01-01", None, None, "bottom", "1", "3", "p", "", "公式戦"), ("g", 3, "H", "A", "2024-01-01", None, None, "bottom", "2", "-1", "r", "z", None)],
        "game_id string, row_order long, home string, away string, date string, home_score double, away_score double, half string, inning string, added_runs string, home_pitcher string, away_pitcher string, game_type string",
    )
    r = one(reports.aggregate_games(ev, harmonise.classify))
    assert (r.home_score, r.away_score, r.home_starter, r.away_starter, r.category) == (3.0, 2.0, "p", "q", "regular")


def test_readers_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"game_id": "1", "prediction_time_utc": "2024-01-01T00:00:00Z", "observations": [{"kind": "WEATHER", "value": "x"}]}) + "\n{broken\n")
    snaps = readers.snapshots(spark, str(tmp_path / "a.jsonl"))
    assert snaps.count() == 1 and readers.observations_of(snaps).first().kind == "WEATHER"
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.txt").write_text("one\n\n  \ntwo\n")
    assert [r.raw_line for r in readers.raw_lines(spark, str(tmp_path / "lines")).collect()] == ["one", "two"]
    game = {"gamePk": "5", "gameDate": "2024-04-01T00:00:00Z", "status": {"detailedState": "Final"}, "teams": {"home": {"score": 3, "team": {"name": "H"}}, "away": {"score": 1, "team": {"name": "A"}}}, "venue": {"name": "V"}}
    (tmp_path / "s.json").write_text(json.dumps({"dates": [{"games": [game, {**game, "gamePk": "6", "status": {"detailedState": "Postponed"}}]}]}))
    assert [r.game_id for r in readers.nested_schedule(spark, str(tmp_path / "s.json")).collect()] == ["5"]
    (tmp_path / "m.csv").write_text("league,game_id,datetime,home,away,home_score,away_score,home_starter,away_starter,venue,game_type,series_description,confirmed_starters\nL,1.0,2024-01-01 00:00:00,a,b,3,6.0,,,v,R,,True\nL,1,2024-01-02 00:00:00,a,b,4,6,,,v,R,,0\nL,2,bad,a,b,1,2,,,v,R,,\n")
    g = readers.games_csv(spark, str(tmp_path / "m.csv")).collect()
    assert len(g) == 1 and g[0].home_score == 4.0
    soccer = spark.createDataFrame([("05/08/2023", "A ", "B", "2", "x")], "Date string, HomeTeam string, AwayTeam string, FTHG string, FTAG string")
    row = one(readers.soccer_matches(soccer))
    assert (str(row.date), row.home_team, row.home_score, row.away_score) == ("2023-08-05", "A", 2, None)
    assert readers.inventory(spark, str(tmp_path)).count() >= 2


def test_store_merge_and_resume(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path))
    base = spark.createDataFrame([(1, 2023, "a"), (2, 2024, "b")], "id long, year int, v string")
    store.merge_into(s, "silver", "games", base, ["id"], ["v"], "year")
    store.merge_into(s, "silver", "games", spark.createDataFrame([(2, 2024, "c"), (3, 2024, "d")], "id long, year int, v string"), ["id"], ["v"], "year")
    assert sorted((r.id, r.v) for r in s.read("silver", "games").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert s.datasets("silver") == ["games"] and s.row_count("silver", "games") == 3 and s.bytes_on_disk("silver", "games") > 0
    left = store.remaining(base, base.filter("id = 1").withColumn("version", F.lit("v1")), ["id"], "v1")
    assert [r.id for r in left.collect()] == [2]


def test_nb_grid_prefers_poisson_on_underdispersed_rows(spark):
    df = spark.createDataFrame([("L", i, 2 + i % 2, 2 + i % 2, 2.5, 2.5) for i in range(100)], "league string, game_id long, home_score int, away_score int, lambda_home double, lambda_away double")
    assert one(calibrate.fit_nb_alpha(df, ["league"])).alpha == 0.0


def test_unknown_stage_raises(spark, games):
    with pytest.raises(KeyError):
        stages.apply_stages(games, ["nope"])
    assert stages.apply_stages(games, ["ratings_only"]) is games


def test_rating_stream_over_batches_equals_batch(spark, games, tmp_path):
    from matchloom.operators import rating

    src = str(tmp_path / "src")
    ordered = games.orderBy("datetime", "game_id").toPandas()
    for i in range(3):
        part = ordered.iloc[i * 60:(i + 1) * 60]
        spark.createDataFrame(part, games.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(games.schema).option("maxFilesPerTrigger", 1).parquet(src)
    clock = held.Clock(spark)
    out = held.run_available(live.rating_stream(stream, clock=clock), "elo", clock)
    assert live.late_count(out).first()["late_rows"] == 0
    got = rows_of(live.on_time(out), ["game_id"])
    want = rows_of(rating.ratings(games), ["game_id"])
    assert got.elo_home.tolist() == pytest.approx(want.elo_home.tolist(), abs=1e-9)
    assert set(got.game_id) == set(want.game_id)
