"""Player profiles: one shuffle, two orders of the rows, and the same means as a loop over games."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import form
from matchloom.plans import ordered
from matchloom.sources import adapters
from matchloom.suite import history


def _lines(spark, odd=None):
    rows = []
    for i in range(140):
        pa = 3 + (i * 7) % 5
        so = odd.get(i, float(i % 3)) if odd else i % 3
        rows.append(("A" if i % 5 else "B", i % 3, i, 1 + i % 28, pa, pa - i % 2, i % 4, i % 2, so, i % 6 != 2))
    kind = "double" if odd else "long"
    df = spark.createDataFrame(rows, f"league string, player_id long, game_id long, day int, pa long, ab long, h long, bb long, so {kind}, eligible boolean")
    return df.withColumn("datetime", F.expr("make_timestamp_ntz(2024, 1, day, 0, 0, 0)")).drop("day")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_profiles_read_two_orders_of_one_shuffle(spark):
    plan = _plan(form.player_profiles(_lines(spark)))
    assert sum("Exchange" in line for line in plan) == 1
    assert sum(line.strip(" :+-").startswith("Sort ") for line in plan) == 2
    assert sum(line.strip(" :+-").startswith("Window ") for line in plan) <= 3


def test_lines_meet_games_in_the_shuffle_that_groups_them(spark):
    lines = adapters.player_games(spark, "/root/testdata/sf0.001")
    assert [line for line in _plan(lines) if "Exchange" in line and "l_partkey" in line] == []
    assert sum("Exchange" in line for line in _plan(lines)) == 1


@pytest.mark.parametrize("sliced", [False, True])
@pytest.mark.parametrize("odd", [None, {7: float("nan"), 8: None, 30: float("inf"), 61: None, 64: None, 67: None}])
def test_profiles_match_loop(spark, request, sliced, odd):
    if sliced:
        request.getfixturevalue("small_groups")
    lines = _lines(spark, odd)
    got = form.player_profiles(lines).toPandas().set_index("game_id")
    past = {}
    for r in sorted(lines.collect(), key=lambda r: (r.datetime, r.game_id)):
        seen = past.setdefault((r.league, r.player_id), [])
        row = got.loc[r.game_id]
        assert row.pp_games == len(seen)
        for name in ("avg", "so_rate", "pa", "lineout_rate"):
            v = np.array([x[name] for x in seen], float)
            ok = np.isfinite(v)
            w = np.exp(-(len(v) - 1 - np.arange(len(v))) / 12.0)
            want = np.average(v[ok], weights=w[ok]) if ok.any() else form.PLAYER_PRIOR[name]
            assert row[f"pp_{name}"] == pytest.approx(want, abs=1e-12)
        five = [x["so_rate"] for x in seen[-5:]]
        assert row.pp_recent_so_rate == pytest.approx(np.mean(five) if five else 0.2, nan_ok=True)
        if r.eligible:
            so = 0.0 if r.so is None else r.so
            seen.append({"avg": r.h / max(r.ab, 1), "so_rate": so / max(r.pa, 1), "pa": r.pa, "lineout_rate": 0.0})


@pytest.mark.parametrize("mean", [True, False])
@pytest.mark.parametrize("eligible", [None, "live"])
def test_decayed_values_over_many_blocks(spark, mean, eligible):
    rows = [("k", i, math.sin(i) + 2.0, i % 7 != 3) for i in range(330)]
    df = spark.createDataFrame(rows, "key string, pos long, x double, live boolean")
    line = ordered.Timeline(df, ["key"], ["pos"], eligible=eligible)
    for present in (False, True):
        got = line.decayed({"m": F.col("x")}, 2.0, block=100, mean=mean, present=present).toPandas().set_index("pos").m
        past = []
        for _, pos, x, live in rows:
            w = np.exp(-(len(past) - 1 - np.arange(len(past))) / 2.0)
            want = np.sum(w * past) / (np.sum(w) if mean else 1.0) if past else np.nan
            assert got[pos] == pytest.approx(want, rel=1e-12, nan_ok=True)
            if live or not eligible:
                past.append(x)


def test_rounding_by_arithmetic_equals_rounding(spark):
    rng = np.random.default_rng(5)
    odd = [0.0, -0.0, 0.0000005, -0.0000005, 1.0000005, 2.5e-6, -1e-7, 1e6, 1e12 + 0.3, 1e300, float("inf"), float("-inf"), float("nan"), None]
    values = odd + [float(v) for v in rng.normal(0, 3, 4000)] + [k / 2e6 for k in range(-1000, 1000)] + [float(v) for v in rng.normal(0, 1e7, 500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    for places in (5, 6):
        got = history.rounded(df, ["i"], ["v"], places)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" in plan
        want = df.select("i", F.round(F.col("v") + 1e-9, places).alias("w"))
        off = got.join(want, "i").filter(~F.col("v").eqNullSafe(F.col("w")) | (F.col("v").cast("string") != F.col("w").cast("string")))
        assert off.count() == 0
