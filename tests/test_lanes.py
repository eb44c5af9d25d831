"""Replays in lanes: the rows of one pass, whatever the guesses; slices that start early run once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.operators import lanes, routing
from matchloom.plans.ordered import GROUP_LIMIT_CONF

CFG = routing.Routing()


def forecasts(n, seed=0, missing=()):
    rng = np.random.default_rng(seed)
    cube = np.stack([rng.dirichlet(a, n) for a in ([5, 2, 4], [3, 3, 3], [8, 1, 4])], axis=1)
    y = (rng.random(n)[:, None] > np.cumsum(cube[:, 0], axis=1)).sum(axis=1).clip(0, 2)
    cube[list(missing)] = np.nan
    return cube, y, rng.random(n), rng.random(n)


def one_by_one(run, cube, y, fd, mm, has):
    parts = [run.block(*(x[a:a + 700] for x in (cube, y, fd, mm)), has) for a in range(0, len(y), 700)]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def assert_same_state(a, b):
    flat = lambda s: [x for part in (s["final"], *s["bank"]) for x in (part["t"], *np.ravel(part["p"]), *part["y"])] + [*np.ravel(s["losses"]), *np.ravel(s["outputs"]), *s["scores"], *s["previous"]]
    np.testing.assert_allclose(flat(a), flat(b), atol=1e-9)
    assert [(p["accepted"], p["rejected"]) for p in (a["final"], *a["bank"])] == [(p["accepted"], p["rejected"]) for p in (b["final"], *b["bank"])]


@pytest.mark.parametrize("n, missing, has", [(6000, (), True), (2300, (), False), (2600, (1400,), True)])
def test_lanes_equal_row_by_row(n, missing, has):
    """Long lanes meet their former course, short ones are done again until each end is what was handed on; a missing forecast stays."""
    data = forecasts(n, missing=missing)
    a, b = routing.Replay(3, 3, CFG), routing.Replay(3, 3, CFG)
    want, got = one_by_one(a, *data, has), routing.replayed(b, *data, has)
    for c in want:
        np.testing.assert_allclose(got[c], want[c], atol=1e-9, err_msg=c)
    assert_same_state(a.state(), b.state())


def test_few_rows_are_worked_on_one_by_one(monkeypatch):
    """Of many rows only the first 120, which fill the histories, and the odd ones at the end."""
    seen = []
    plain = routing.Replay.block
    monkeypatch.setattr(routing.Replay, "block", lambda self, raw, *rest: seen.append(len(raw)) or plain(self, raw, *rest))
    routing.replayed(routing.Replay(3, 3, CFG), *forecasts(9000), False)
    assert seen[0] == 120 and sum(seen) < 120 + 9000**0.5


def test_sums_over_powers_of_two():
    x = np.random.default_rng(1).random((300, 2))
    sums, faded = lanes.ladder(x, 67), lanes.ladder(x, 96, 0.9)
    for i in (96, 150, 299):
        assert lanes.over(sums, 67, i, 1)[0] == pytest.approx(x[i - 66:i + 1].sum(axis=0))
        assert lanes.over(faded, 96, i, 1, 0.9)[0] == pytest.approx((x[i - 95:i + 1] * 0.9 ** np.arange(95, -1, -1)[:, None]).sum(axis=0))


@pytest.mark.parametrize("warm", [1600, 8])
def test_slices_that_start_early_run_once(spark, monkeypatch, warm):
    """With enough rows ahead no slice is done again; with too few the rows are the same after more rounds."""
    monkeypatch.setattr(routing, "WARM", warm)
    cube, y, *_ = forecasts(5000, 4)
    # Experts as good as the first one, whose temperatures move often and so forget soon.
    cube = routing.unit(0.9 * cube[:, :1] + 0.1 * cube)
    pdf = pd.DataFrame({"league": ["A"] * 5000, "game_id": range(5000), "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(5000) // 3, "h"), "actual": y})
    names = ["e0", "e1", "e2"]
    e = spark.createDataFrame(pdf.assign(**{n: [v.tolist() for v in cube[:, j]] for j, n in enumerate(names)}))
    shown = lambda df: df.select("game_id", F.element_at("routed", 1).alias("r"), F.element_at("weights", 1).alias("w"), "temperature", "drift", "conformal").toPandas().sort_values("game_id").reset_index(drop=True)
    whole = shown(routing.replay(e, names))
    spark.conf.set(GROUP_LIMIT_CONF, "1700")
    try:
        log = []
        cut = shown(routing.replay(e, names, log=log))
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)
    assert log[0] >= 3 and (len(log) == 1) == (warm > 8)
    pd.testing.assert_frame_equal(whole, cut, atol=1e-8)
    want = one_by_one(routing.Replay(3, 3, CFG), cube, y, np.zeros(5000), np.zeros(5000), False)
    np.testing.assert_allclose(whole["r"], want["routed"][:, 0], atol=1e-9)


def test_drifts_are_computed_once(spark, monkeypatch):
    """The recursion reads what the windows left, however often it goes over the rows."""
    plans = []
    plain = routing.scan
    monkeypatch.setattr(routing, "scan", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a, **k))
    k = F.col("id")
    vector = F.array(((k % 7 + 2) / 20.0).cast("double"), F.lit(0.2), (F.lit(0.8) - (k % 7 + 2) / 20.0).cast("double"))
    rows = spark.range(150).select(k.alias("game_id"), F.lit("A").alias("league"), F.timestamp_seconds(k * 3600).alias("datetime"), (k % 3).alias("actual"), vector.alias("e0"), (k % 11).cast("double").alias("x"))
    assert routing.replay(rows, ["e0"], features=["x"]).filter("drift > 0").count() > 100
    assert len(plans) == 1 and "Window" not in plans[0]
