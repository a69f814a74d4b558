"""Whitening of vectors by their leading principal components, found without ever forming the covariance.

Entries become integers, x = floor(scale * c) + shift, so that sums and deviations are exact. A block Lanczos process asks
for the covariance's product with a few columns at a time: each product is one pass over the rows, in which every task sums
centred outer products and Spark adds the tasks' sums up by dimension. On the driver are a basis of `most_basis` columns of
the vectors' width at most, which is reorthogonalised in full, twice, against all of itself. Directions in which a block
breaks down are started anew at random; a basis that is full is restarted from its best Ritz vectors. It ends when the
residuals of all wanted pairs are small, or the basis spans the whole space. The trace comes from the exact deviations.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, packed, ready

#: Entries from here on don't become integers exactly; eigenvalues below that share of the largest are noise.
MOST, NOISE = float(2**43), 1e-10


class Fit(NamedTuple):
    """n rows, their sums by dimension, the sum of their deviations; components' eigenvalues (falling) and, as columns, unit
    vectors; their shares of the trace; the number of passes."""

    n: int
    sums: list[int]
    deviations: int
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    passes: int
    scale: int
    shift: int


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(row, c): all columns as one struct and the vector of each row that can be used, written. A vector that is null,
    empty, or holds entries that are null, not finite or beyond 2^43 goes; of several widths the most frequent stays (the
    larger, if two are)."""
    c = F.col(f"`{column}`").cast("array<double>")
    fine = F.coalesce(F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < MOST), F.lit(False))) & (F.size(c) > 0), F.lit(False))
    rows = cut(ready(vectors.sparkSession) and vectors.where(fine).select(packed(vectors, "row"), F.col(f"`{column}`").alias("c")), "vectors")
    widths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(2)
    return rows.where(F.size("c") == widths[0]["d"]) if len(widths) > 1 else rows


def _integers(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(len(column), -1) + shift


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as 64-bit integers where they suffice, else as Python's."""
    if max(n * int(np.abs(x).max(initial=0)), *map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(apart: np.ndarray) -> list[int] | np.ndarray:
    """The sum of each row's squares, exactly."""
    if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < 1 << 62:
        return (apart * apart).sum(1)
    return (apart.astype(object) ** 2).sum(1)


def _column_sums(x: np.ndarray) -> list[int]:
    return (x if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object)).sum(0).tolist()


def _decimals(values: list[int]) -> pa.Array:
    """A value of over 38 digits is null."""
    return pa.array([v if abs(v) < 10**38 else None for v in map(int, values)], pa.decimal128(38, 0))


def _totals(rows: DataFrame, sums_of, width: int) -> list[int]:
    """The sums over all rows of width integers that sums_of(column) gives for a batch."""

    def task(batches):
        total = [0] * width
        for batch in batches:
            if len(batch):
                total = [a + int(b) for a, b in zip(total, sums_of(batch.column(0)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), _decimals(total)], names=["j", "v"])

    out = [0] * width
    for r in rows.select("c").mapInArrow(task, "j int, v decimal(38,0)").groupBy("j").agg(F.sum("v").alias("v")).collect():
        out[r["j"]] = int(r["v"] or 0)
    return out


def _summed(rows: DataFrame, shape: tuple[int, int], product) -> np.ndarray:
    """The sum over all rows of the matrix that product(column) gives for a batch."""
    names = [f"v{i}" for i in range(shape[1])]

    def task(batches):
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += product(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), *(pa.array(total[:, i].copy()) for i in range(shape[1]))], names=["j", *names])

    got = rows.select("c").mapInArrow(task, "j int, " + ", ".join(f"{x} double" for x in names)).groupBy("j").agg(*(F.sum(x).alias(x) for x in names))
    out = np.zeros(shape)
    for r in got.collect():
        out[r["j"]] = [r[x] for x in names]
    return out


def _fresh(w: np.ndarray, basis: np.ndarray, scale: float, rng) -> np.ndarray:
    """As many orthonormal columns as w has, orthogonal to the basis: w's directions, and random ones where those end."""
    width = min(w.shape[1], basis.shape[0] - basis.shape[1])
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    new = u[:, :width][:, s[:width] > max(scale * 1e-13, 1e-300)]
    while new.shape[1] < width:
        known = np.hstack((basis, new))
        more = rng.standard_normal((basis.shape[0], width - new.shape[1]))
        for _ in range(3):
            more = more - known @ (known.T @ more)
            more = np.linalg.qr(more)[0]
        new = np.hstack((new, more))
    for _ in range(2):
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    return new


def lanczos(product, d: int, k: int, block: int, tolerance: float = 1e-13, most_passes: int = 200, most_basis: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric matrix and their unit vectors, as columns, from product(columns) alone, and
    how many products it took. It is an error if the residuals aren't within the tolerance of the largest after most_passes."""
    rng, k, block = np.random.default_rng(12), min(k, d), min(block, d)
    most_basis = max(most_basis, 4 * k + 2 * block)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = _fresh(rng.standard_normal((d, block)), basis, 0.0, rng)
    for at in range(most_passes):
        basis, image = np.hstack((basis, new)), np.hstack((image, product(new)))
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        own = basis @ y[:, :k]
        left = image @ y[:, :k] - own * values[:k]
        most = max(float(np.abs(values).max()), 0.0)
        if basis.shape[1] == d or basis.shape[1] >= k and (np.linalg.norm(left, axis=0) <= tolerance * most).all():
            return values[:k], own / np.linalg.norm(own, axis=0), at + 1
        following = image[:, -new.shape[1] :]
        if basis.shape[1] + block > most_basis:
            keep = y[:, : 2 * k + block]
            following, basis, image = left, basis @ keep, image @ keep
            basis, r = np.linalg.qr(basis)
            image = np.linalg.solve(r.T, image.T).T
        new = _fresh(following, basis, most, rng)
    raise RuntimeError(f"residuals were not within {tolerance} of the largest eigenvalue after {most_passes} passes")


def fit(rows: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, block: int = 8) -> Fit | None:
    """The leading components of usable() rows, all of them; None if there is no row. Components without variance (below
    1e-10 of the first's) are left out."""
    first = rows.select(F.size("c").alias("d")).head()
    if first is None:
        return None
    d = first["d"]
    *sums, n = _totals(rows, lambda c: [*_column_sums(_integers(c, scale, shift)), len(c)], d + 1)
    (deviations,) = _totals(rows, lambda c: [sum(map(int, _squares(_apart(_integers(c, scale, shift), n, sums))))], 1)

    def product(q: np.ndarray) -> np.ndarray:
        def of(column):
            x = _apart(_integers(column, scale, shift), n, sums).astype(np.float64) / n
            return x.T @ (x @ q)

        return _summed(rows, q.shape, of) / n

    values, vectors, passes = lanczos(product, d, components, max(block, min(components, d)))
    real = values > max(NOISE * values[0], 0.0)
    trace = deviations / n**3
    return Fit(n, sums, deviations, values[real], vectors[:, real], values[real] / trace if real.any() else values[real], passes, scale, shift)


def _projected(column: pa.Array, own: Fit) -> tuple[np.ndarray, np.ndarray]:
    apart = _apart(_integers(column, own.scale, own.shift), own.n, own.sums)
    return apart, (apart.astype(np.float64) / own.n) @ (own.vectors / np.sqrt(own.values))


def identity_error(rows: DataFrame, own: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(own.values)
    if not k:
        return 0.0

    def of(column):
        w = _projected(column, own)[1]
        return np.vstack((w.T @ w, w.sum(0)))

    total = _summed(rows, (k + 1, k), of) / own.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0.0))


def apply(rows: DataFrame, own: Fit) -> DataFrame:
    """row, deviation (decimal, null beyond 38 digits) and whitened (an entry for each component) of usable() rows."""

    def task(batches):
        for batch in batches:
            if len(batch):
                apart, w = _projected(batch.column(1), own)
                squares = _squares(apart)
                dev = pa.array(squares).cast(pa.decimal128(38, 0)) if squares.dtype != object else _decimals(squares)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32) if w.shape[1] else np.zeros(len(w) + 1, np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), dev, lists], names=["row", "deviation", "whitened"])

    return rows.mapInArrow(task, f"row {rows.schema['row'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def whitened(vectors: DataFrame, components: int = 8, column: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row for each usable row and component: row (all columns of vectors as one struct), component (from 1, by falling
    eigenvalue), n, deviation, whitened, explained, identity_error.

    vectors needs the column of vectors; others come back in row whatever their names and nulls. Which rows are usable, see
    usable(); all of them are fitted on. Repeated rows count each. Components without variance have no rows: equal vectors
    and a single one have none, a table without usable rows has none. Of equal eigenvalues any orthonormal vectors are
    taken, the same for all rows.
    """
    rows = usable(vectors, column)
    own = fit(rows, components, scale, shift)
    if own is None:
        own = Fit(1, [0], 0, np.zeros(0), np.zeros((1, 0)), np.zeros(0), 0, scale, shift)
        rows = rows.limit(0)
    error, shares = identity_error(rows, own), F.array(*map(F.lit, own.explained.tolist())).cast("array<double>")
    found = apply(rows, own).select("row", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return found.select("row", (F.col("i") + 1).alias("component"), F.lit(own.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def digests(vectors: DataFrame) -> DataFrame:
    """whitened() by vec_id; a deviation beyond a long is null."""
    return whitened(vectors.select("vec_id", "embedding")).select("row.vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
