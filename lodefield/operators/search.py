"""Retrieval from end to end: channels, fusion, rerank, diversity, activation, budget, confidence."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import STOPWORDS, approx_tokens, tokenize
from . import postings
from . import retrieval as R
from .selection import mmr, within_budget
from .words import hashed, likeness

# A hit's quality and how the decision's confidence follows from it and from the query's support.
SUPPORT = 2.0 / 3.0


def support(hits: DataFrame, query: str, corpus: DataFrame, most: int = 5, index: str | None = None) -> DataFrame:
    """(support): the share of the query's content words, weighed by how rare they are in the corpus (doc_id, text), that
    the first hits (place, text) have between them. index: where the corpus' stored index is, if it has one."""
    words = F.array_distinct(F.filter(tokenize(F.lit(query)), lambda t: ~t.isin(STOPWORDS) & (F.length(t) > 2)))
    wanted = corpus.sparkSession.range(1).select(F.explode(words).alias("term"))
    if index:
        df = postings.frequencies(corpus.sparkSession, index, [r["term"] for r in wanted.collect()], corpus)  # the query's words
    else:
        own = corpus.join(F.broadcast(corpus.sparkSession.range(1).select(words.alias("asked"))))
        df = own.select(F.explode(F.array_intersect(tokenize(F.col("text")), F.col("asked"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    weight = F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 0.5))
    weights = wanted.join(df, "term", "left").join(F.broadcast(n)).select("term", F.greatest(weight, F.lit(0.05)).alias("w"))
    have = hits.where(F.col("place") <= most).select(F.explode(tokenize(F.col("text"))).alias("term")).distinct().withColumn("has", F.lit(1))
    both = weights.join(have, "term", "left")
    return both.agg((F.coalesce(F.sum(F.when(F.col("has") == 1, F.col("w"))), F.lit(0.0)) / F.coalesce(F.sum("w"), F.lit(1.0))).alias("support"))


def confidence(hits: DataFrame, supported: DataFrame) -> DataFrame:
    """(confidence) of hits (place, score, tier, channels): qualities weighed by rank and relevance, by the margin of the
    first, by how many there are, and by the query's support."""
    # The weights of a hit's quality, and how the query's support bears on the confidence.
    top = F.max("score").over(_all())
    relevance = F.col("score") / F.greatest(F.col("top"), F.lit(0.01))
    trust = 1 - F.col("tier") / 5.0
    parts = F.least(F.size(F.split("channels", r"\+")) / 3.0, F.lit(1.0))
    quality = (0.03 + 0.25 * relevance + 0.35 * trust + 0.10 * parts + 0.27 / 3) * (0.55 + 0.45 * trust)
    weight = (relevance + 0.01 / F.greatest(F.col("top"), F.lit(0.01))) / F.col("place")
    own = hits.withColumn("top", top).withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))).withColumn("w", weight)
    got = own.agg((F.sum(F.col("q") * F.col("w")) / F.greatest(F.sum("w"), F.lit(0.01))).alias("c"), F.max("score").alias("first"), F.sort_array(F.collect_list("score"), False).alias("s"), F.count(F.lit(1)).alias("n"))
    second = F.coalesce(F.get("s", F.lit(1)), F.col("first"))
    margin = F.when(F.col("n") > 1, 0.90 + 0.10 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("first") - second) / F.greatest("first", F.lit(0.01))))).otherwise(1.0)
    eq = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c") * margin * (0.85 + 0.15 * F.least(F.col("n") / 3.0, F.lit(1.0)))))
    strength = F.when(F.col("first") > 1, F.least(F.lit(1.0), F.log1p("first") / math.log1p(12.0))).otherwise(F.greatest(F.lit(0.25), F.col("first")))
    s = F.col("support")
    many = F.when(s < SUPPORT, eq * (1.28 + 0.14 * (1 - s / SUPPORT))).otherwise(eq * (1.21 + 0.10 * (s - SUPPORT) / (1 - SUPPORT) + 0.04 * strength))
    few = F.when(s < SUPPORT, F.least(eq, 0.05 * s / SUPPORT)).otherwise(eq)
    value = F.when(F.col("n") < 4, few).otherwise(F.least(F.lit(0.91), many))
    return got.join(F.broadcast(supported)).select(F.when(F.col("n") == 0, 0.0).otherwise(value).alias("confidence"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def retrieve(docs: DataFrame, query: str, now: datetime, k: int = 8, budget: int = 4096, width: int = 32, weights: dict[str, float] | None = None, most_tier: int = 4, most_sensitive: int = 3, abstain: float = 0.45, dims: int = 64, index: str | None = None) -> DataFrame:
    """(place, doc_id, score, channels, used, confidence, abstains): up to k documents (doc_id, text, tier, sensitivity, ts)
    for a query, within a budget of tokens.

    Readable documents are scored by BM25 and by hashed embeddings; a span of time in the query weighs both; ranks are
    fused, the first `width` reranked by both likenesses, spread by maximal marginal relevance, weighed by trust and age,
    and packed. What comes after the fusion is at most `width` rows. index: the stored index of docs, if there is one."""
    readable = docs.where((F.coalesce("tier", F.lit(5)) <= most_tier) & (F.coalesce("sensitivity", F.lit(0)) <= most_sensitive) & F.col("text").isNotNull())
    span = dates.window(query, now)
    at = docs.sparkSession.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]  # the query's own tokens
    vector = hashed(list(at), dims).tolist()

    dense = likeness(readable.select("doc_id", tokenize(F.col("text")).alias("tokens")), vector, dims)
    lexical = postings.bm25(docs.sparkSession, index, query, within=readable) if index else R.bm25(readable, query)
    if span:
        times = readable.select("doc_id", dates.window_factor(F.col("ts").cast("timestamp"), span[0], span[1]).alias("factor"))
        lexical, dense = (x.join(times, "doc_id").select("doc_id", (F.col("score") * F.col("factor")).alias("score")) for x in (lexical, dense))
    ranked = [R.ranked(x.where("score > 0").withColumn("score", F.round("score", 9)), name, "evidence", "doc_id", 4 * width) for x, name in ((lexical, "lexical"), (dense, "vector"))]
    fused = R.rrf(ranked[0].unionByName(ranked[1]), weights=weights).withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "id").limit(width)
    own = F.broadcast(fused.select(F.col("id").alias("doc_id"), "channels")).join(readable, "doc_id").withColumn("tokens", tokenize(F.col("text")))

    def rescored(batches):
        q = np.array(vector)
        counts = pd.Series(list(at), dtype=object).value_counts().to_dict()
        for pdf in batches:
            rows = [hashed(list(t), dims) for t in pdf["tokens"]]
            tf = [pd.Series(list(t), dtype=object).value_counts().to_dict() for t in pdf["tokens"]]
            words = [sum((1 + math.log(f[w])) * n for w, n in counts.items() if w in f) / math.sqrt(max(1, sum(f.values()))) for f in tf]
            score = [round(max(0.0, 0.55 * a + 0.45 * float(v @ q)), 9) for a, v in zip(words, rows)]
            yield pdf.assign(score=score, vector=[v.tolist() for v in rows])[["doc_id", "channels", "tier", "ts", "text", "score", "vector"]]

    kinds = dict(own.dtypes)
    near = own.mapInPandas(rescored, f"doc_id long, channels string, tier {kinds['tier']}, ts {kinds['ts']}, text string, score double, vector array<double>").persist()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    spread = mmr(near.select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("id"), rank.alias("rank"), "score", "vector", F.array(*map(F.lit, vector)).alias("query_vector")), k)
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400.0)
    top = F.max("score").over(Window.partitionBy())
    activation = 0.55 * F.col("score") / F.greatest(top, F.lit(0.01)) + 0.20 * 0.7 * (1 - F.col("tier") / 5.0) + 0.15 * F.coalesce(F.pow(F.lit(0.5), age / 30.0), F.lit(0.5))
    chosen = near.join(spread.select(F.col("id").alias("doc_id")), "doc_id").withColumn("score", F.round(F.col("score") * (0.5 + activation), 9))
    packed = within_budget(chosen.select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("id"), F.struct((-F.col("score")).alias("s"), "doc_id").alias("rank"), approx_tokens(F.col("text")).alias("cost")), budget)
    kept = packed.select(F.col("id").alias("doc_id"), "place", "used").join(chosen, "doc_id")
    sure = confidence(kept, support(kept, query, readable, index=index))
    return kept.join(F.broadcast(sure)).select("place", "doc_id", F.round("score", 6).alias("score"), "channels", "used", F.round("confidence", 6).alias("confidence"), (F.col("confidence") < abstain).alias("abstains"))
