"""Whitening against a dense eigendecomposition, and the Lanczos process where blocks break down or bases fill up."""

import math

import numpy as np
import pytest
from lodefield.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, component string, row int"


def dense(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    apart = n * x - sums
    c = apart / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return (apart.astype(object) ** 2).sum(1), c @ v / np.sqrt(e), e / (np.square(c).sum() / n)


def test_query_against_dense(spark):
    got = queries.op12_embedding_whitening(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    dev, w, share = dense(rows["embedding"].tolist(), 8)
    assert len(got) == 8 * len(rows) and set(got["n"]) == {len(rows)} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert got["deviation"].dtype == np.int64 and got["component"].dtype == np.int32
    for j in range(8):
        own = got[got["component"] == j + 1].set_index("vec_id").loc[rows["vec_id"]]
        assert own["deviation"].tolist() == dev.tolist()
        a, b = own["whitened"].to_numpy(), w[:, j]
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-8
        assert np.allclose(own["explained"], share[j], rtol=1e-10)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 5)) * [9, 5, 3, 0, 1e-3]
    fine = [(i if i % 9 else None, r.tolist(), "c", None) for i, r in enumerate(x)]
    odd = [(900, None, "c", 1), (901, [], "c", 1), (902, [1.0, None, 2.0, 3.0, 4.0], "c", 1), (903, [1.0, math.nan, 2.0, 3.0, 4.0], "c", 1), (904, [math.inf, 0.0, 0.0, 0.0, 0.0], "c", 1), (905, [1e300, 0.0, 0.0, 0.0, 0.0], "c", 1), (906, [1.0, 2.0], "c", 1)]
    out = whitening.whitened(spark.createDataFrame(fine + odd + fine[:3], SCHEMA).repartition(3))
    got = out.selectExpr("row.vec_id", "row.component as c", "component", "n", "deviation", "whitened", "identity_error").toPandas()
    dev, w, _ = dense(x.tolist() + x[:3].tolist(), 4)
    assert set(got["n"]) == {53} and len(got) == 53 * 4  # a dimension is constant: four components
    assert got["identity_error"].max() < 1e-4 and set(got["c"]) == {"c"} and got["vec_id"].max() < 50
    first = got[got["component"] == 1]
    assert np.allclose(sorted(first["whitened"].abs()), sorted(np.abs(w[:, 0])), atol=1e-9)
    assert sorted(map(int, first["deviation"])) == sorted(dev.tolist())


def test_large_entries_are_exact(spark):
    """Deviations beyond 64 bits are exact decimals, and null as a long."""
    rows = [(i, [float(i * 2**36), 1.0], "c", 1) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    dev, _, _ = dense([r[1] for r in rows], 1)
    assert {int(r["deviation"]) for r in whitening.whitened(frame).collect()} == set(dev.tolist()) and max(dev) > 1 << 63
    assert whitening.digests(frame).where("deviation is null").count() > 0


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25], "c", 1)], [(1, [0.5, 0.25], "c", 1)] * 9, [(1, None, "c", 1)]])
def test_without_variance(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


@pytest.mark.parametrize("d,k,block,basis", [(300, 6, 4, 40), (40, 8, 8, 256), (5, 8, 8, 256), (1, 1, 1, 8)])
def test_lanczos(d, k, block, basis):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = 2.0 ** -np.arange(d)
    a = (q * e) @ q.T
    values, vectors, passes = whitening.lanczos(lambda x: a @ x, d, k, block, most_basis=basis)
    k = min(k, d)
    assert np.allclose(values, e[:k], rtol=1e-9, atol=1e-14) and np.allclose(np.abs((vectors * q[:, :k]).sum(0)), 1, atol=1e-9)
    assert passes < 60


def test_lanczos_breaks_down():
    """Three distinct eigenvalues only: blocks end after three products, and the multiplicities are found."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((60, 60)))[0]
    e = np.array([5.0] * 3 + [2.0] * 4 + [0.0] * 53)
    a = (q * e) @ q.T
    values, vectors, _ = whitening.lanczos(lambda x: a @ x, 60, 7, 2)
    assert np.allclose(values, e[:7]) and np.allclose(a @ vectors, vectors * values, atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(7), atol=1e-10)
