"""Measures of rankings and confidences, and calibration."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written
from .ranges import PART, around, dealt, nth, running


def ranking_scores(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, dcg, ndcg) of hits (query_id, id, rank) against relevant (query_id, id): each relevant id counts
    once, at its best rank. Queries without hits have 0, those without relevant ids no row."""
    need = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    top = hits.where(F.col("rank") <= k).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    got = top.join(relevant.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("need"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = need.join(got, "query_id", "left")
    return out.select("query_id", (F.coalesce("found", F.lit(0)) / F.col("need")).alias("recall"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, n, mean, top and one column for each share): exact percentiles, linear between neighbours. Values are counted
    first, so that equal ones are one row; distinct ones are dealt by range, and only sums of ranges are gathered by key,
    so that no task holds all values of a key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "values")
    by_part = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("k", "part").agg(F.sum("c").alias("m"))
    parts = parts.select("k", "part", F.coalesce(F.sum("m").over(by_part), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("k")).alias("n"))
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(parts, ["k", "part"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") <= place) & (place < F.col("upto")), F.col("v")))

    def share(q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        part = F.max(place - F.floor(place))
        return at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part

    out = rows.groupBy("k").agg(F.max("n").alias("n"), *(share(q).alias(name) for name, q in shares.items()), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), F.max("v").alias("top"))
    return out.withColumnRenamed("k", key)


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both bounds, within 0 and 1."""
    p, zz = successes / total, z * z
    mid, span = p + zz / (2 * total), F.lit(z) * F.sqrt((p * (1 - p) + zz / (4 * total)) / total)
    return F.greatest(F.lit(0.0), (mid - span) / (1 + zz / total)), F.least(F.lit(1.0), (mid + span) / (1 + zz / total))


def draws(seed: int, n: int, size: int) -> Iterator[np.ndarray]:
    """Arrays of `size` numbers each, without end: what random.Random(seed).randrange(n) gives one after the other. Python
    takes the upper bits of the generator's words and passes over those that are too large; so does this, many at a time."""
    bits = n.bit_length()
    if bits > 32:
        rng = random.Random(seed)
        while True:
            yield np.array([rng.randrange(n) for _ in range(size)], np.int64)
    *key, pos = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
    parts, have = [], 0
    while True:
        while have < size:
            got = (words.random_raw(min(max(1024, 2 * (size - have)), 1 << 20)) >> (32 - bits)).astype(np.int64)
            parts.append(got[got < n])
            have += len(parts[-1])
        whole = np.concatenate(parts)
        yield whole[:size]
        parts, have = [whole[size:]], len(whole) - size


def bootstrap(rows: DataFrame, key: str, value: str, q: float | None = None, iterations: int = 2000, alpha: float = 0.05, seed: int = 1234) -> DataFrame:
    """(key, point, low, high) of the mean of each key's values in the order of `seq`, or of their q-quantile, by percentile
    bootstrap with Python's generator: equal rows give equal intervals. A key's values are held in one task."""

    def of(x: np.ndarray) -> float:
        return float(np.quantile(x, q)) if q is not None else float(sum(x.tolist()) / len(x))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("seq")[value].to_numpy(float)
        low = high = point = of(x)
        if len(x) > 1:
            drawn = draws(seed, len(x), len(x))
            own = sorted(of(x[next(drawn)]) for _ in range(iterations))
            low, high = (float(np.quantile(own, p)) for p in (alpha / 2, 1 - alpha / 2))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "point": [point], "low": [low], "high": [high]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "seq", value).groupBy(key).applyInPandas(run, f"{key} {kind}, point double, low double, high double")


def probability_better(posteriors: DataFrame, samples: int = 2048) -> DataFrame:
    """(key, p_better): how often a draw from Beta(a, b) exceeds one from Beta(c, d), by Python's generator from 0."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(*x: float) -> float:
            rng = random.Random(0)
            return sum(rng.betavariate(x[0], x[1]) > rng.betavariate(x[2], x[3]) for _ in range(samples)) / samples

        return pd.Series([one(*x) for x in zip(a, b, c, d)])

    return posteriors.select("key", share("a", "b", "c", "d").alias("p_better"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank of its value: counts by value come first, ranks are given to distinct values by ranges.
    A null value has none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranks = running(counts, value, {"upto": "n"}).select(F.col(value).alias("of"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("of"), "left").drop("of")


def _pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring blocks (from, to, sum, count) pooled until means grow from one to the next."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), total.tolist(), n.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, top, s, c = out.pop()
            out[-1][1:] = [top, out[-1][2] + s, out[-1][3] + c]
    return tuple(np.array([b[i] for b in out], float) for i in range(4))


_BLOCK = "lo double, hi double, total double, n double"


def isotonic_blocks(rows: DataFrame, score: str, outcome: str, slopes: int = 512) -> DataFrame:
    """(lo, hi, total, n): the blocks of scores, clamped to 0 and 1, that share a fitted value.

    The fit is the lower convex hull of (count, sum) over scores. Outcomes are summed by score; each range of scores pools
    its own blocks. For `slopes` values spread over those of all blocks, each range names its point where a line of that
    slope touches it; the lowest of these for a slope is a corner of the hull itself. Between two corners only blocks whose
    slope is between theirs can hold another corner: what lies beyond is taken together, and each stretch between corners is
    pooled by itself. So no task has the blocks of all."""
    own = rows.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))).alias("x"), F.col(outcome).cast("double").alias("y")).where("x is not null and y is not null")
    sums = dealt(own.groupBy("x").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("n")), "x")
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.groupBy(PART).agg(F.sum("n").alias("n"), F.sum("total").alias("t")).select(F.col(PART).alias("p"), *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}0") for c in ("n", "t")))

    def pool(key, pdf):
        pdf = pdf.sort_values("x")
        lo, hi, total, n = _pooled(*(pdf[c].to_numpy(float) for c in ("x", "x", "total", "n")))
        return pd.DataFrame({PART: key[0], "lo": lo, "hi": hi, "total": total, "n": n, "n1": pdf["n0"].iloc[0] + np.cumsum(n), "t1": pdf["t0"].iloc[0] + np.cumsum(total)})

    blocks = sums.join(F.broadcast(starts), F.col(PART) == F.col("p")).groupBy(PART).applyInPandas(pool, f"{PART} int, {_BLOCK}, n1 double, t1 double")
    blocks = written(blocks, "blocks")
    of = blocks.agg(F.percentile_approx(F.col("total") / F.col("n"), [i / slopes for i in range(slopes + 1)], 20 * slopes).alias("m")).first()["m"]
    marks = np.unique(np.array(of or [], float))

    def touch(key, pdf):
        pdf = pdf.sort_values("lo")
        first = pdf.iloc[0]
        n = np.concatenate(([first["n1"] - first["n"]], pdf["n1"]))
        t = np.concatenate(([first["t1"] - first["total"]], pdf["t1"]))
        at = np.searchsorted((pdf["total"] / pdf["n"]).to_numpy(), marks, "left")
        return pd.DataFrame({"mark": np.arange(len(marks)), "below": t[at] - marks * n[at], "n": n[at]})

    points = blocks.groupBy(PART).applyInPandas(touch, "mark int, below double, n double")
    corner = points.groupBy("mark").agg(F.min(F.struct("below", "n")).alias("c")).select("mark", "c.n").orderBy("mark").collect()  # a row for each slope
    corners = np.maximum.accumulate(np.array([r["n"] for r in corner])) if corner else np.zeros(0)

    def between(key, pdf):
        """Blocks with their stretch; neighbours beyond one side's slope are one."""
        pdf = pdf.sort_values("lo")
        mid = (pdf["n1"] - pdf["n"] / 2).to_numpy()
        at = np.searchsorted(corners, mid, "right")  # stretch i lies between corners i - 1 and i
        slope = (pdf["total"] / pdf["n"]).to_numpy()
        low = np.where(at > 0, marks[np.maximum(at - 1, 0)], -np.inf)
        high = np.where(at < len(marks), marks[np.minimum(at, len(marks) - 1)], np.inf)
        side = np.where(slope < low, -1, np.where(slope > high, 1, 0))
        new = np.ones(len(pdf), bool)
        new[1:] = (at[1:] != at[:-1]) | (side[1:] != side[:-1]) | (side[1:] == 0)
        run = np.cumsum(new)
        return pdf.assign(stretch=at, run=run).groupby(["stretch", "run"], as_index=False).agg(lo=("lo", "min"), hi=("hi", "max"), total=("total", "sum"), n=("n", "sum"))[["stretch", "lo", "hi", "total", "n"]]

    def last(key, pdf):
        pdf = pdf.sort_values("lo")
        return pd.DataFrame(dict(zip(("lo", "hi", "total", "n"), _pooled(*(pdf[c].to_numpy(float) for c in ("lo", "hi", "total", "n"))))))

    return written(blocks.groupBy(PART).applyInPandas(between, f"stretch int, {_BLOCK}").groupBy("stretch").applyInPandas(last, _BLOCK), "fit")


def isotonic(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """(x, y): the fitted value at each distinct score, scores clamped to 0 and 1; y does not fall."""
    blocks = isotonic_blocks(rows, score, outcome).select("lo", (F.col("total") / F.col("n")).alias("y"))
    x = rows.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))).alias("x")).where(F.col("x").isNotNull() & F.col(outcome).isNotNull()).distinct()
    return around(x, blocks, "x", "lo").select("x", F.col("below.y").alias("y"))


def interpolated(scores: DataFrame, knots: DataFrame, score: str) -> DataFrame:
    """scores with y, straight between the two knots (x, y) around each score, and an end's value beyond it; null where the
    score is, or without knots."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))
    found = around(scores.withColumn("clamped_score", F.when(F.col(score).isNotNull(), s)), knots.select("x", "y"), "clamped_score")
    t = (F.col("clamped_score") - F.col("below.x")) / (F.col("above.x") - F.col("below.x"))
    y = F.when(F.col("below").isNull(), F.col("above.y")).when(F.col("above").isNull() | (F.col("below.x") == F.col("above.x")), F.col("below.y")).otherwise(F.col("below.y") + t * (F.col("above.y") - F.col("below.y")))
    return found.withColumn("y", y).drop("clamped_score", "below", "above")


def conformal_threshold(scores: DataFrame, score: str, coverage: float) -> DataFrame:
    """(threshold): the score at place max(0, int((n + 1) * (1 - coverage)) - 1) from below, of n scores clamped to 0 and 1;
    1 without scores. Places are counted over ranges of distinct scores."""
    own = scores.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))).alias("s")).where("s is not null and not isnan(s)")
    n = own.count()
    if not n:
        return scores.sparkSession.createDataFrame([(1.0,)], "threshold double")
    return nth(own, "s", min(n - 1, max(0, int((n + 1) * (1.0 - coverage)) - 1))).select(F.col("value").alias("threshold"))
