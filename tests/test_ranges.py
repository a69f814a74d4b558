"""Orders over ranges against sorting, and an isotonic fit of many blocks against pooling all in one place."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodefield.operators import evaluation, ranges

ONE_TASK = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pooled(x, y):
    blocks = []
    for v, t, n in pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["sum", "count"]).itertuples():
        blocks.append([[v], t, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return {v: t / n for vs, t, n in blocks for v in vs}


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps", "one"])
@pytest.mark.parametrize("slopes", [4, 512])
def test_isotonic(spark, shape, slopes):
    rng = np.random.default_rng(len(shape))
    n = 4000
    x = np.round(rng.random(n), 3) if shape != "rising" else rng.permutation(n) / n
    p = {"noise": 0.5 + 0 * x, "rising": x, "falling": 1 - x, "steps": np.floor(4 * x) / 4, "one": 0 * x}[shape]
    y = (x * 100).round(0) if shape == "rising" else (rng.random(n) < p).astype(float)
    x = np.full(n, 0.5) if shape == "one" else x
    df = spark.createDataFrame(pd.DataFrame({"s": x, "o": y})).repartition(6)
    want = pooled(x, y)
    blocks = evaluation.isotonic_blocks(df, "s", "o", slopes).toPandas().sort_values("lo")
    got = {v: t / c for lo, hi, t, c in blocks.itertuples(index=False) for v in want if lo <= v <= hi}
    assert got.keys() == want.keys() and np.allclose([got[v] for v in want], list(want.values()), rtol=1e-12, atol=1e-12)
    fit = evaluation.isotonic(df, "s", "o")
    assert not any(k in plan_of(fit) for k in ONE_TASK)
    got = {r["x"]: r["y"] for r in fit.collect()}
    assert got.keys() == want.keys() and np.allclose([got[v] for v in want], list(want.values()))


def test_around(spark):
    """Knots on both sides of each row, with rows of one value over many ranges, and nulls."""
    rows = [(i, float(v)) for i, v in enumerate([3.0] * 400 + [-1.0, 0.0, 0.5, 9.0, 10.0, 7.25])] + [(999, None)]
    df = spark.createDataFrame(rows, "i long, s double").repartition(5)
    knots = spark.createDataFrame([(0.0, "a"), (3.0, "b"), (7.0, "c"), (9.0, "d")], "x double, name string")
    got = {r["i"]: (r["below"] and r["below"]["name"], r["above"] and r["above"]["name"]) for r in ranges.around(df, knots, "s").collect()}
    assert len(got) == len(rows) and all(got[i] == ("b", "b") for i in range(400))
    assert [got[400 + i] for i in range(6)] == [(None, "a"), ("a", "a"), ("a", "b"), ("d", "d"), ("d", None), ("c", "d")] and got[999] == (None, None)
    assert {(r["below"], r["above"]) for r in ranges.around(df, knots.limit(0), "s").collect()} == {(None, None)}


def test_running_and_nth(spark):
    rng = np.random.default_rng(1)
    v = rng.permutation(5000)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "n": v % 7}))
    got = ranges.running(df, "v", {"upto": "n"}).toPandas().sort_values("v")
    assert got["upto"].tolist() == np.cumsum(np.arange(5000) % 7).tolist()
    same = spark.createDataFrame(pd.DataFrame({"v": [5] * 300 + [7] * 10 + [1]}))
    assert [ranges.nth(same, "v", k).first()[0] for k in (0, 1, 300, 301, 310)] == [1, 5, 5, 7, 7] and ranges.nth(same, "v", 311).count() == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0), (6, 5.0)], "i long, v double")
    got = {r["i"]: r["r"] for r in evaluation.average_ranks(df, "v", "r").collect()}
    assert got == {1: 3.0, 2: 3.0, 6: 3.0, 3: 1.0, 4: None, 5: 5.0}
