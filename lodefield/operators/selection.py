"""Choice and order within a query's ranked hits. Folds over one query's hits take them as an Arrow group: hits are the
few that ranking has left, a bounded number for each query."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize


def _folded(hits: DataFrame, fold, extra: str = "") -> DataFrame:
    """fold(pdf in rank order) -> (indices chosen, in order) for each query, as (query_id, id, place)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], ignore_index=True)
        at = fold(pdf)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[at], "id": pdf["id"].iloc[at], "place": np.arange(1, len(at) + 1)})

    return hits.groupBy("query_id").applyInPandas(run, "query_id long, id long, place long")


def mmr(hits: DataFrame, k: int, weight: float = 0.72) -> DataFrame:
    """(query_id, id, place) of k hits (query_id, id, rank, score, vector, query_vector): each time the one with the
    largest weight * cosine with the query - (1 - weight) * largest cosine with a chosen one + score. A hit without a
    vector has neither of the first two. The earlier of equals goes first."""

    def fold(pdf: pd.DataFrame) -> list[int]:
        has = pdf["vector"].notna().to_numpy()
        width = max((len(v) for v in pdf["vector"][has]), default=0)
        x = np.zeros((len(pdf), width))
        for i in np.flatnonzero(has):
            x[i, : len(pdf["vector"].iloc[i])] = pdf["vector"].iloc[i]
        q = np.asarray(pdf["query_vector"].iloc[0], float)[:width]
        base, alike = weight * (x[:, : len(q)] @ q) + pdf["score"].to_numpy(float), x @ x.T
        chosen, nearest = [], np.full(len(pdf), -np.inf)
        open_ = np.ones(len(pdf), bool)
        while len(chosen) < k and open_.any():
            value = np.where(open_, base - (1 - weight) * np.where(has & np.isfinite(nearest), nearest, 0.0), -np.inf)
            best = int(np.argmax(value))
            chosen.append(best)
            open_[best] = False
            if has[best]:
                nearest = np.maximum(nearest, alike[best])
        return chosen

    return _folded(hits, fold)


def mmr_normalized(hits: DataFrame, k: int, weight: float = 0.72) -> DataFrame:
    """As mmr(), with relevance the score's share of the best one, and the overlap of token sets (column tokens) standing
    in for the cosine where either hit has no finite vector or their widths differ."""

    def fold(pdf: pd.DataFrame) -> list[int]:
        score = np.nan_to_num(pdf["score"].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0).clip(0)
        relevance = score / score.max() if len(score) and score.max() > 0 else score * 0
        vectors = [np.asarray(v, float) if v is not None and len(v) and np.isfinite(np.asarray(v, float)).all() else None for v in pdf["vector"]]
        tokens = [set(t) for t in pdf["tokens"]]

        def alike(i: int, j: int) -> float:
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b):
                return float(min(1.0, max(0.0, a @ b)))
            both = len(tokens[i] | tokens[j])
            return len(tokens[i] & tokens[j]) / both if both else 0.0

        chosen, rest = [], list(range(len(pdf)))
        penalty = np.zeros(len(pdf))
        while rest and len(chosen) < k:
            best = max(rest, key=lambda i: (weight * relevance[i] - (1 - weight) * penalty[i], -i))
            chosen.append(best)
            rest.remove(best)
            for i in rest:
                penalty[i] = max(penalty[i] if len(chosen) > 1 else -math.inf, alike(i, best))
        return chosen

    return _folded(hits, fold)


def marginal_gain(hits: DataFrame, budget: int, cost: float = 0.05, redundancy: float = 0.5) -> DataFrame:
    """(query_id, id, place): hits (tokens; n_words is their cost) in order, up to the first that does not fit the budget or
    whose share of the best score, less redundancy * its likeness to a chosen one, is below cost."""

    def fold(pdf: pd.DataFrame) -> list[int]:
        score = pdf["score"].to_numpy(float).clip(0)
        top = score.max() if len(score) and score.max() > 0 else 1.0
        counts = [pd.Series(list(t), dtype=object).value_counts().to_dict() for t in pdf["tokens"]]

        def alike(a: dict, b: dict) -> float:
            got = sum((1 + math.log(b[t])) * n for t, n in a.items() if t in b)
            return got / math.sqrt(max(1, sum(b.values())))

        chosen, used = [], 0
        for i in range(len(pdf)):
            n = max(1, int(pdf["n_words"].iloc[i]))
            if used + n > budget:
                break
            gain = score[i] / top - redundancy * max((alike(counts[i], counts[j]) for j in chosen), default=0.0)
            if chosen and gain < cost:
                break
            chosen.append(i)
            used += n
        return chosen

    return _folded(hits, fold)


def covering(hits: DataFrame, width: int = 40) -> DataFrame:
    """(query_id, id, place) of all hits (facets: numbers of the query's facets that a hit covers): as long as facets are
    open, the first of the next `width` that covers one goes first, else the next in order."""

    def fold(pdf: pd.DataFrame) -> list[int]:
        facets = [set(f) for f in pdf["facets"]]
        open_, rest, chosen = set().union(*facets) if facets else set(), list(range(len(pdf))), []
        while rest:
            best = next((i for i in rest[:width] if facets[i] & open_), rest[0])
            chosen.append(best)
            rest.remove(best)
            open_ -= facets[best]
        return chosen

    return _folded(hits, fold)


def within_budget(hits: DataFrame, budget: int, cost: str = "cost") -> DataFrame:
    """The hits (query_id, id, rank, cost) that fit, in order; one that does not fit is passed over, later ones may fit.
    A fold in the JVM over each query's hits."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", F.col(cost).cast("long").alias("cost"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id: bigint, used: bigint>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        after = s["used"] + x["cost"]
        taken = F.struct(after.alias("used"), F.concat(s["kept"], F.array(F.struct(x["id"].cast("long").alias("id"), after.alias("used")))).alias("kept"))
        return F.when(after <= budget, taken).otherwise(s)

    kept = F.aggregate(rows, start, step, lambda s: s["kept"])
    return hits.groupBy("query_id").agg(kept.alias("kept")).select("query_id", F.posexplode("kept").alias("pos", "x")).select("query_id", F.col("x.id").alias("id"), (F.col("pos") + 1).cast("long").alias("place"), F.col("x.used").alias("used"))


def spread(hits: DataFrame, at: str = "ts", score: str = "score", granularity: str = "auto") -> DataFrame:
    """hits with bucket and place: buckets of time in turn, each by score, buckets by their best score. The auto granularity
    is years beyond 365 days of a query's hits, months beyond 45, ISO weeks beyond 7, else days. Hits without a time
    come last. Ties: by id."""
    when = F.col(at).cast("timestamp")
    span = (F.max(when).over(Window.partitionBy("query_id")).cast("double") - F.min(when).over(Window.partitionBy("query_id")).cast("double")) / 86400
    kind = F.when(span > 365, "year").when(span > 45, "month").when(span > 7, "week").otherwise("day") if granularity == "auto" else F.lit(granularity)
    own = hits.withColumn("spread_kind", kind)
    name = (
        F.when(F.col("spread_kind") == "year", F.date_format(at, "yyyy"))
        .when(F.col("spread_kind") == "month", F.date_format(at, "yyyy-MM"))
        .when(F.col("spread_kind") == "week", F.concat(F.extract(F.lit("YEAROFWEEK"), at), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0")))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )
    own = own.withColumn("bucket", name)
    inside = Window.partitionBy("query_id", "bucket").orderBy(F.desc(score), "id")
    own = own.withColumn("spread_round", F.row_number().over(inside)).withColumn("spread_top", F.max(score).over(Window.partitionBy("query_id", "bucket"))).withColumn("spread_first", F.first("id").over(inside))
    order = Window.partitionBy("query_id").orderBy(F.col("bucket").isNull(), F.when(F.col("bucket").isNull(), F.lit(0)).otherwise(F.col("spread_round")), F.desc("spread_top"), "spread_first", F.desc(score), "id")
    return own.withColumn("place", F.row_number().over(order).cast("long")).drop("spread_kind", "spread_round", "spread_top", "spread_first")


def lifted(hits: DataFrame, live: DataFrame) -> DataFrame:
    """(query_id, id, place, score, lifted): hits (query_id, id, rank, score) with the live successor of each superseded one
    right above it, with its score. live (id, end) tells what superseded what in the end; a successor stands at its best
    place alone, whether it was a hit itself or not."""
    own = hits.join(live, "id", "left").withColumn("end", F.coalesce("end", "id"))
    there = own.select("query_id", "id", (F.col("rank") * 2 + 1).alias("spot"), "score", F.lit(False).alias("lifted"))
    above = own.where("end <> id").select("query_id", F.col("end").alias("id"), (F.col("rank") * 2).alias("spot"), "score", F.lit(True).alias("lifted"))
    best = there.union(above).groupBy("query_id", "id").agg(F.min("spot").alias("spot"), F.max("score").alias("score"), F.max("lifted").alias("lifted"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("spot", "id"))
    return best.select("query_id", "id", place.cast("long").alias("place"), "score", "lifted")


def trimmed(rows: DataFrame, terms: list[str], most_tokens: int, text: str = "text") -> DataFrame:
    """rows whose texts are the window of their paragraphs with most of the terms, within most_tokens (of four characters):
    texts that fit stay whole. Where windows are equal the first is taken; marks tell what was left out."""

    wanted, cost, room = set(terms), lambda s: max(1, -(-len(s) // 4)), max(80, most_tokens - 20)

    def one(whole: str | None, paragraph_tokens) -> str | None:
        if whole is None or cost(whole) <= most_tokens:
            return whole
        parts = [p for p in whole.split("\n") if p.strip(" ")] or [whole]
        gains = [sum(x in wanted for x in own) for own in paragraph_tokens] + [0] * len(parts)
        best = (-1, 0, 0)
        for i in range(len(parts)):
            used, gain, j = 0, 0, i
            while j < len(parts) and (j == i or used + cost(parts[j]) <= room):
                used, gain, j = used + cost(parts[j]), gain + gains[j], j + 1
            best = max(best, (gain, -i, j), key=lambda b: b[:2])
        i, j = -best[1], best[2]
        own = "\n\n".join(parts[i:j])
        cut = cost(own) > most_tokens
        own = own[: 4 * most_tokens] if cut else own
        return ("[... truncated ...]\n\n" if i else "") + own + ("\n\n[... truncated ...]" if cut or j < len(parts) else "")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{text: [one(w, k) for w, k in zip(pdf[text], pdf["trim_tokens"])]}).drop(columns="trim_tokens")

    own = rows.withColumn("trim_tokens", F.transform(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""), tokenize))
    return own.mapInPandas(run, rows.schema)
