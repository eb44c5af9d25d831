"""Work that grows with the input only, whatever the keys and times look like."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from matchloom.operators import drift, joins, routing
from matchloom.plans.durable import fresh_path
from matchloom.plans.ordered import GROUP_LIMIT_CONF, Timeline
from matchloom.streaming import held, live
from matchloom.suite import scores

HOUR = 3_600_000_000


def most_rows(df):
    """The rows of the step of a plan that puts out the most, once the plan has run."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            made = plan.metrics().get("numOutputRows")
            most = max(most, made.get().value() if made.isDefined() else 0)
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def nearest(rows, readings):
    return joins.nearest(rows, readings, ["venue"], "event_id", "t", "at", ["temp"], 6 * HOUR)


def test_dense_readings_are_not_paired_with_every_row(spark):
    rows = spark.range(1500).select(F.col("id").alias("event_id"), F.lit(1).alias("venue"), (F.col("id") * 1000).alias("t"))
    readings = spark.range(1500).select(F.lit(1).alias("venue"), (F.col("id") * 1000 + 400).alias("at"), F.col("id").cast("double").alias("temp"))
    assert most_rows(nearest(rows, readings)) < 10_000


def test_nearest_equals_all_pairs(spark):
    """Repeated and null keys, ties, gaps of just the reach, rows without a place or time."""
    rng = random.Random(4)
    step = HOUR // 2
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 3]), rng.choice([None, *(step * k for k in range(-60, 60))])) for _ in range(300)]
    readings = [(rng.choice([None, 1, 2]), rng.choice([None, *(step * k for k in range(-60, 60, 7))]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(40)]
    left = spark.createDataFrame(rows, "event_id long, venue long, t long")
    got = nearest(left, spark.createDataFrame(readings, "venue long, at long, temp double")).select("event_id", "venue", "t", "at", "temp", "quality")
    temps = {}
    for venue, at, temp in readings:
        temps.setdefault((venue, at), []).append(temp)
    best = {}
    for key, venue, t in rows:
        for (place, at), seen in temps.items():
            if None not in (key, venue, t, at) and place == venue and abs(at - t) <= 6 * HOUR:
                best[key] = min(best.get(key, (1 << 62,)), (abs(at - t), at, max((x for x in seen if x is not None), default=None)), key=lambda b: b[:2])
    want = []
    for key, venue, t in rows:
        _, at, temp = best.get(key, (None, None, None))
        want.append((key, venue, t, at, temp, "UNKNOWN" if at is None else "EXACT" if at == t else "NEAREST"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_processors_travel_after_drift_has_run(spark, games):
    """Once used, a function of Spark holds the session; kept by a module it went with every processor of the package."""
    drift.mmd_drift(games.withColumn("x", F.col("game_id") % 7), ["x"]).collect()
    processor = live.Routed("datetime", ["datetime"], ["league"], 60, ["e0"], routing.Routing(), 3)
    assert cloudpickle.dumps(processor)


def tables(spark, orders=200):
    """A folder with the tables behind the games."""
    folder = fresh_path(spark, "tables")
    small = {
        "region": spark.range(5).selectExpr("cast(id as int) r_regionkey", "concat('R', id) r_name"),
        "nation": spark.range(25).selectExpr("cast(id as int) n_nationkey", "concat('N', id) n_name", "cast(id % 5 as int) n_regionkey"),
        "customer": spark.range(50).selectExpr("id c_custkey", "cast(id % 25 as int) c_nationkey"),
        "orders": spark.range(orders).selectExpr("id o_orderkey", "id * 7 % 50 o_custkey", "substr('FOP', cast(id % 3 as int) + 1, 1) o_orderstatus", "timestamp_seconds(1700000000 + 43200 * (id % 90)) o_orderdate"),
    }
    for name, df in small.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_games_are_not_broadcast(spark):
    out = scores.rest_travel_games(spark, tables(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [game_id" not in plan and "SortMergeJoin [game_id" in plan
    assert out.count() == 200


class Kept:
    """State of one key in memory: a value, or a map."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def keys(self):
        return iter(self.map)

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


class Seen(held.InOrder):
    def take(self, key, rows, now):
        yield rows


def test_waiting_rows_are_released_in_stretches(monkeypatch):
    """Two years of rows that a late watermark releases at once come in order, and never all in one frame."""
    timers, rng = [], random.Random(2)
    handle = SimpleNamespace(getMapState=lambda *_: Kept(), getListState=lambda *_: Kept(), getValueState=lambda *_: Kept(), registerTimer=timers.append)
    one = Seen("at", ["at", "n"], ["at", "n"], 3600)
    one.init(handle)
    hours = [rng.randrange(730 * 24) for _ in range(2000)]
    rows = pd.DataFrame({"at": pd.to_datetime(pd.Series(hours), unit="h"), "n": range(2000)})
    for low in range(0, 2000, 500):
        assert not list(one.handleInputRows(("k",), iter([rows[low:low + 250], rows[low + 250:low + 500]]), None))
    assert min(timers) == (min(hours) + 1) * 3_600_000
    middle, end = (SimpleNamespace(getCurrentWatermarkInMs=lambda ms=ms: ms) for ms in (400 * 86_400_000, 10**13))
    first, second = (list(one.handleExpiredTimer(("k",), now, None)) for now in (middle, end))
    assert max(map(len, first + second)) < 200
    assert timers[-1] == (min(h for h in hours if h >= 400 * 24) + 1) * 3_600_000
    assert all((f["at"] < "1971-02-05").all() for f in first)
    pd.testing.assert_frame_equal(pd.concat(first + second, ignore_index=True), rows.sort_values(["at", "n"]).reset_index(drop=True))
    assert [len(f) for f in one.handleInputRows(("k",), iter([rows[:3]]), None)] == [3]


def test_a_replay_in_blocks_equals_row_by_row(monkeypatch):
    """Candidates of the experts' temperatures are found for all rows at once; blocks of any size give the same rows."""
    rng = np.random.default_rng(5)
    p, y = rng.dirichlet([3, 2, 3], 700), rng.integers(0, 3, 700)
    one, all_ = routing.Temperature(routing.Routing()), routing.Temperature(routing.Routing())
    want = []
    for row, hit in zip(p, y):
        want.append(one.t)
        one.resolve(row, hit)
    got = np.concatenate([all_.resolve_all(p[a:b], y[a:b]) for a, b in ((0, 5), (5, 96), (96, 97), (97, 700))])
    assert one.accepted and got.tolist() == want and all_.state() == one.state()
    pdf = pd.DataFrame({"league": "A", "game_id": range(700), "actual": y, "feature_drift": rng.random(700), "feature_mmd": rng.random(700)})
    pdf = pdf.assign(e0=list(p), e1=list(rng.dirichlet([3, 2, 3], 700)))
    step = routing.replay_step(["e0", "e1"], ["league"], routing.Routing(), 3)
    whole, after = step(pdf, None)
    monkeypatch.setattr(routing, "BLOCK", 17)
    parts, again = step(pdf, None)
    pd.testing.assert_frame_equal(whole, parts, check_exact=True)
    assert after == again


def test_tasks_follow_the_rows(spark):
    """Keys below the limit are dealt to more tasks than the session's few shuffle partitions, so no task sorts many of them."""
    rows = spark.range(4000).selectExpr("id % 200 as k", "id as t", "id % 3 = 0 as live")
    spark.conf.set(GROUP_LIMIT_CONF, "50")
    try:
        for live_only in (None, "live"):
            line = Timeline(rows, ["k"], ["t"], eligible=live_only)
            assert not line.sliced
            for out in (line.rolling({"x": F.col("t")}, [3]), line.running({"x": F.col("t")}), line.positions()):
                most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
                assert most < 400 and out.count() == 4000
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)


def test_kernel_scale_is_the_median_of_all_positive_distances():
    rng = np.random.default_rng(6)
    for recent, current in ((rng.random((40, 12, 3)), rng.random((40, 3))), (rng.integers(0, 2, (40, 12, 2)), rng.integers(0, 2, (40, 2))), (np.ones((3, 12, 2)), np.ones((3, 2)))):
        got = drift.mmd_scores(recent.astype(float), current.astype(float))
        for window, now, score in zip(recent.astype(float), current.astype(float), got):
            sd = np.maximum(window.std(axis=0, ddof=1), 1e-6)
            pool = np.vstack([window, now]) / sd
            d2 = ((pool[:, None] - pool) ** 2).sum(axis=2)
            gamma = 1 / (2 * np.median(d2[d2 > 1e-15])) if (d2 > 1e-15).any() else 0.5
            k = np.exp(-gamma * np.minimum(d2, 1e6))
            assert abs(score - max(0, 1 - np.exp(-max(k[:12, :12].mean() + 1 - 2 * k[:12, 12].mean(), 0)))) < 1e-9


def test_windows_of_vectors_are_read_whole():
    """Windows that are missing or too short score zero, the others as their vectors do."""
    rng = np.random.default_rng(7)
    past, now = rng.random((30, 12, 3)), rng.random((30, 3))
    windows = [None if i % 5 == 0 else list(p[: 12 - (i % 7 == 0)]) for i, p in enumerate(past)]
    got = drift._mmd(pd.Series(windows), pd.Series(list(now))).to_numpy()
    want = drift.mmd_scores(past, now)
    assert [g if w is not None and len(w) == 12 else 0 for g, w in zip(want, windows)] == got.tolist()
