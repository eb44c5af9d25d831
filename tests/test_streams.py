"""Streams: one file and 24 shuffled files give the rows of the batch operators; late rows are kept aside."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.operators import context, rating, routing
from matchloom.plans.durable import fresh_path
from matchloom.streaming import live
from matchloom.streaming.held import Clock, run_available

HOLD = "3000 days"


def streamed(spark, df, files, per_batch=8):
    """A stream of ``df`` as one file, or dealt by chance to so many files of which a micro-batch takes some."""
    path = fresh_path(spark, "layout")
    if files == 1:
        df.coalesce(1).write.parquet(path)
    else:
        df.repartition(files, F.rand(5)).write.option("maxRecordsPerFile", 100_000).parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def drained(spark, build, df, files, hold=HOLD, **options):
    clock = Clock(spark)
    out = run_available(build(streamed(spark, df, files), hold=hold, clock=clock, **options), "stream", clock).cache()
    return out


def same(a, b):
    key = lambda r: tuple(repr(x) for x in r)
    columns = sorted(a.columns)
    return sorted(map(key, a.select(*columns).collect())) == sorted(map(key, b.select(*columns).collect()))


@pytest.fixture(scope="module")
def observations(spark):
    rng = random.Random(8)
    kinds = {
        "STARTER": ["a", "b"], "LINEUP": ["x", "y"], "INJURY": ["out", "IL", "active", "Returned", "?"], "WEATHER": ["1,2", "1,3"],
        "AVAILABILITY": ["PLAYER_OUT", "player_returned", "NONE"], "MARKET": ["1", None], "BULLPEN": ["p", "q"],
        "REST_TRAVEL": ['{"home":{"rest_days":2.5},"away":{"rest_days":1}}', '{"home":{"rest_days":1},"away":{"rest_days":1}}', "word", '{"home":{"rest_days":"x"}}', '{"away":{"rest_days":3}}'],
    }
    rows = []
    for i in range(900):
        kind = rng.choice(list(kinds))
        t = 1_700_000_000 + rng.randrange(60) * 43_200
        rows.append((i, rng.randrange(12), t, t - rng.choice([60, 600, -60]), kind, rng.choice(["verified", "PROJECTED", "UNKNOWN", None]), rng.choice(kinds[kind])))
    df = spark.createDataFrame(rows, "event_id long, game_id long, p long, a long, kind string, state string, value string")
    return df.select("event_id", "game_id", F.timestamp_seconds("p").alias("prediction_time"), F.timestamp_seconds("a").alias("available_at"), "kind", "state", "value").cache()


@pytest.mark.parametrize("files", [1, 24])
def test_snapshots(spark, observations, files):
    rows = observations.select("game_id", "prediction_time", "event_id")
    got = live.on_time(drained(spark, live.deduplicated, rows, files, order=["event_id"]))
    assert same(got, rows.groupBy("game_id", "prediction_time").agg(F.max("event_id").alias("event_id")))


@pytest.mark.parametrize("files", [1, 24])
def test_changes_equal_batch(spark, observations, files):
    want = context.delta_events(observations).select("event_id", "game_id", "event")
    events = {r["event"] for r in want.select("event").distinct().collect()}
    assert {"PLAYER_OUT", "PLAYER_RETURNED", "REST_ASYMMETRY", "MARKET_MOVED", "BULLPEN_STATE_CHANGED"} <= events
    assert same(live.on_time(drained(spark, live.change_stream, observations, files)), want)


def test_finished_games_are_forgotten(spark, observations):
    """With a short idle time the rows do not depend on the layout, and a game's first observation after it has no past."""
    outs = [live.on_time(drained(spark, live.change_stream, observations, files, idle_days=1)) for files in (1, 24)]
    assert same(*outs)
    assert outs[0].count() != context.delta_events(observations).count()


@pytest.mark.parametrize("files", [1, 24])
def test_sliding_counts(spark, observations, files):
    rows = observations.select("kind", "prediction_time")
    got = live.on_time(drained(spark, lambda s, **o: live.sliding_counts(s, "kind", "prediction_time", **o), rows, files))
    want = rows.groupBy(F.window("prediction_time", "7 days", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    assert same(got, want.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n"))


@pytest.mark.parametrize("files", [1, 24])
def test_settlement(spark, files):
    rng = random.Random(6)
    ledger = spark.createDataFrame([(i, 1_700_000_000 + 3600 * rng.randrange(900)) for i in range(300)] + [(5, 1_700_000_000)], "game_id long, t long").cache()
    both = ledger.select("game_id", F.timestamp_seconds("t").alias("datetime"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("long").alias("home_score"), F.lit(None).cast("long").alias("away_score"))
    hours = {i: rng.choice([1, 4, 5, 20, 48, 49]) for i in range(300)}
    known = {}
    for r in ledger.collect():
        known.setdefault(r["game_id"], []).append(r["t"])
    results = [(i, min(known[i]) + 3600 * hours[i], i % 7, i % 5) for i in range(0, 300, 2)] + [(i, min(known[i]) + 3600 * 30, 9, 0) for i in range(0, 300, 6)]
    published = spark.createDataFrame(results, "game_id long, t long, home_score long, away_score long")
    rows = both.unionByName(published.select("game_id", F.timestamp_seconds("t").alias("published_at"), "home_score", "away_score"), allowMissingColumns=True).cache()

    def build(stream, **options):
        return live.settled(stream.filter("published_at is null"), stream.filter("published_at is not null"), **options)

    got = live.on_time(drained(spark, build, rows, files)).select("game_id", F.unix_timestamp("datetime").alias("t"), "home_score", "away_score", "actual")
    want = []
    for i, starts in known.items():
        for t in starts:
            first = min((r[1:] for r in results if r[0] == i and 5 * 3600 <= r[1] - t <= 48 * 3600), default=None)
            if first:
                want.append((i, t, first[1], first[2], 0 if first[1] > first[2] else 1 if first[1] == first[2] else 2))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("files", [1, 24])
@pytest.mark.parametrize("rule", ["main", "margin"])
def test_online_ratings_equal_batch(spark, games, files, rule):
    got = live.on_time(drained(spark, live.rating_stream, games, files, rule=rule))
    assert same(got, rating.ratings(games, rule).select("league", "game_id", "elo_home", "elo_away", "elo_expected"))


@pytest.mark.parametrize("files", [1, 24])
def test_online_routing_equals_replay(spark, games, files):
    k = F.col("game_id")
    vector = lambda m, b: F.array((k % m + b) / 60.0, F.lit(0.2), F.lit(0.8) - (k % m + b) / 60.0)
    rows = games.crossJoin(spark.range(3).select(F.col("id").alias("again"))).withColumn("game_id", k + 1000 * F.col("again")).drop("again")
    rows = rows.withColumns({"e0": vector(17, 8), "e1": vector(11, 14), "e2": vector(23, 5), "actual": F.when(k % 5 < 2, 0).when(k % 5 == 2, 1).otherwise(2)})
    rows = rows.select("league", "game_id", "datetime", "actual", "e0", "e1", "e2").cache()
    names = ["e0", "e1", "e2"]
    got = live.on_time(drained(spark, lambda s, **o: live.routing_stream(s, names, **o), rows, files))
    want = routing.replay(rows, names).select(*got.columns)
    a, b = (x.toPandas().sort_values("game_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, atol=1e-12)


def test_late_rows_go_to_the_side(spark, games):
    """With no hold, games that come after their league has moved on are marked and counted; nothing is lost."""
    clock = Clock(spark)
    out = run_available(live.rating_stream(streamed(spark, games, 24, per_batch=1), hold="0 seconds", clock=clock), "late", clock).cache()
    late = live.late_count(out).first()["late_rows"]
    assert 0 < late < games.count() and live.on_time(out).count() + late == games.count()
    assert out.filter("late and elo_home is not null").count() == 0


def test_row_rules_equal_column_rules(spark, observations):
    """One table of rules serves both forms."""
    known = observations.filter("available_at <= prediction_time").toPandas().sort_values(["prediction_time", "available_at", "event_id"])
    last, want = {}, []
    for r in known.itertuples():
        state = None if r.state is None else r.state.upper()
        want += [(r.event_id, e) for e in context.row_events(r.kind, last.get((r.game_id, r.kind)), state, r.value)]
        last[r.game_id, r.kind] = (state, r.value)
    got = [(r["event_id"], r["event"]) for r in context.delta_events(observations).collect()]
    assert sorted(got) == sorted(want)
