"""How the near-duplicate search of vectors measures itself, and centres that are fitted in two levels."""

import numpy as np
import pytest
from lodefield.llm import vectors

SCHEMA = "label long, w int, node long, n long, x array<double>"


def table(spark, x, label=1):
    return spark.createDataFrame([(label, len(v), i, 1, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)


def pairs(rng, n, near):
    """n directions of which the first `near` have a neighbour of cosine above 0.99."""
    x = rng.standard_normal((n, 32))
    y = x[:near] + 0.05 * rng.standard_normal((near, 32))
    return np.concatenate((x, y))


def test_lost_links_show(spark):
    """A result without any link is found out if there are links, however few."""
    rng = np.random.default_rng(1)
    none = spark.createDataFrame([], "node long, links long, root long")
    assert vectors.audited(table(spark, pairs(rng, 3000, 20)), none, 0.98, 64) == 0.0
    assert vectors.audited(table(spark, pairs(rng, 3000, 1)), none, 0.98, 64, whole=20_000) == 0.0
    assert vectors.audited(table(spark, pairs(rng, 1000, 0)), none, 0.98, 64) == 1.0
    assert vectors.audited(table(spark, pairs(rng, 2, 0)).limit(0), none, 0.98, 64) == 1.0


def test_witnesses_are_ends_of_links(spark):
    rng = np.random.default_rng(2)
    x = pairs(rng, 2000, 200)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = set(np.flatnonzero(((u @ u.T >= 0.98).sum(1) > 1)).tolist())
    got = {r["node"] for r in vectors.witnesses(table(spark, x), 0.98).collect()}
    assert got <= linked and len(got) > 0.5 * len(linked)


def test_two_levels_of_centres(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(16) + 6 * np.eye(16)[i % 8]).tolist(), 5) for i in range(1500)] + [(2000 + i, [1.0] + [0.0] * 15, 7) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = frame.selectExpr("cast(label as long) label", "16 w", "xxhash64(vec_id) node", "1L n", "embedding x")
    made = vectors._centres(nodes, sample=60, per_cell=50)
    assert set(made) == {5} and 15 <= len(made[5]) <= 60 and made[5].shape[1] == 16
    few = vectors.near_vectors(frame, threshold=0.9, per_cell=50, sample=60).orderBy("vec_id").toPandas()
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([r[2] for r in rows])
    want = ((u @ u.T >= 0.9) & (same[:, None] == same)).sum(1) - 1
    assert few["n_links"].sum() >= 0.95 * want.sum() and (few["n_links"].to_numpy() <= want).all()


@pytest.mark.parametrize("label", [None, 3])
def test_no_vectors(spark, label):
    frame = spark.createDataFrame([(1, None, label)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in vectors.near_vectors(frame).collect()] == [(1, 0, 1, True)]
