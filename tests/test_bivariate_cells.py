"""Bivariate score cells against a plain sum."""

import math
import random

from pyspark.sql import functions as F

from matchloom.operators import scorelines


def bivariate(home, away, shared):
    mh, ma = max(home, 1e-9), max(away, 1e-9)
    s = min(max(shared, 0.0), mh, ma)
    pmf = lambda k, lam: math.exp(-max(lam, 1e-300) + k * math.log(max(lam, 1e-300)) - math.lgamma(k + 1))
    cells = {(h, a): sum(pmf(h - k, mh - s) * pmf(a - k, ma - s) * pmf(k, s) for k in range(min(h, a) + 1)) for h in range(7) for a in range(7)}
    cells[999, 999] = max(1.0 - sum(cells.values()), 0.0)
    total = sum(cells.values())
    return {c: p / total for c, p in cells.items()}


def test_bivariate_cells(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(0, 6), rng.uniform(0, 6), rng.choice([0.0, 0.4, 2.0]), rng.randrange(9), rng.randrange(9)) for i in range(60)]
    rows += [(60, 3.0, 3.0, 0.0, 1, 1), (61, None, 2.0, 0.4, 0, 0), (62, 40.0, 50.0, 0.4, 2, 2)]
    df = spark.createDataFrame(rows, "id long, lambda_home double, lambda_away double, shared double, h long, a long")
    out = scorelines.bivariate_candidates(df, F.col("shared")).withColumn("nll", scorelines.categorical_nll(F.col("space"), F.col("h"), F.col("a")))
    got = {r["id"]: r for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "round(" not in plan  # no cell becomes a decimal number, no loop is interpreted
    for i, home, away, shared, h, a in rows:
        want = bivariate(home or 0.0, away, shared)
        cells = {(c["h"], c["a"]): c["p"] for c in got[i]["space"]}
        assert cells.keys() == want.keys() and all(abs(cells[c] - want[c]) < 1e-12 for c in want)
        best = sorted(want, key=lambda c: (-round(want[c], 12), c))[:4]
        assert [c["label"] for c in got[i]["candidates"]] == ["OTHER" if c == (999, 999) else f"{c[0]}-{c[1]}" for c in best]
        seen = (999, 999) if h >= 7 or a >= 7 else (h, a)
        assert abs(got[i]["nll"] + math.log(max(want[seen], 1e-12))) < 1e-6  # OTHER is what is left of one
