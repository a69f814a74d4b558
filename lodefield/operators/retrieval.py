"""Lexical and dense scoring, candidates, channels and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IRREGULAR, let, query_terms, stem, tokenize


def _prefix(s: Column) -> Column:
    """What every regular word of the stem begins with."""
    return F.when(s.endswith("y") & (F.length(s) >= 4), F.left(s, F.length(s) - 1)).otherwise(s)


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, text: str = "text") -> DataFrame:
    """(doc_id, score) of documents with any of the query's stems; idf, number of documents and mean length are those of
    all documents. A document's length and matches are kept between the two passes, its text is read once. Only tokens
    that begin like a stem, or are irregular, are stemmed."""
    wanted, odd = F.col("wanted"), F.array(*map(F.lit, IRREGULAR))
    asked = docs.sparkSession.range(1).select(query_terms(tokenize(F.lit(query))).alias("wanted"))
    asked = asked.select("wanted", F.transform("wanted", _prefix).alias("heads"))  # one row: made once, not for each text
    near = lambda t: F.exists("heads", lambda p: t.startswith(p)) | F.array_contains(odd, t)
    rows = docs.select("doc_id", tokenize(F.col(text)).alias("t")).join(F.broadcast(asked))
    stems = F.filter(F.transform(F.filter("t", near), stem), lambda s: F.array_contains(wanted, s))
    rows = rows.select("doc_id", F.size("t").alias("len"), stems.alias("hits"), "wanted").persist()
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("mean"))  # one row
    tf = F.transform(F.array_distinct("hits"), lambda s: F.struct(s.alias("term"), F.size(F.filter("hits", lambda x: x == s)).alias("tf"), F.size(F.filter(wanted, lambda x: x == s)).alias("qtf")))
    each = rows.where(F.size("hits") > 0).select("doc_id", "len", F.explode(tf).alias("x")).select("doc_id", "len", "x.*")
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has stems
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("qtf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return each.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy("doc_id").agg(F.sum(part).alias("score"))


def lexical_score(query_tokens: Column, tokens: Column, length: Column | None = None) -> Column:
    """The sum of (1 + ln tf) for each token of the query, over the root of the text's length: no statistics needed. tokens
    may be those of the query's alone where the length is given."""

    def part(n: Column) -> Column:
        return F.when(n > 0, 1 + F.log(n.cast("double"))).otherwise(0.0)

    own = F.transform(query_tokens, lambda q: let(F.size(F.filter(tokens, lambda t: t == q)), part))
    return F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.greatest(F.size(tokens) if length is None else length, F.lit(1)))


def lexical(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    asked = docs.sparkSession.range(1).select(tokenize(F.lit(query)).alias("asked"))
    rows = docs.select("doc_id", tokenize(F.col(text)).alias("t")).join(F.broadcast(asked))
    # let() keeps the optimizer from filtering again for each of the query's tokens.
    hits = F.filter("t", lambda t: F.array_contains(F.col("asked"), t))
    return rows.select("doc_id", let(hits, lambda own: lexical_score(F.col("asked"), own, F.size("t"))).alias("score"))


def match_clauses(stems: DataFrame) -> DataFrame:
    """(term, clause): for each stem a clause that finds its words by prefix, and one for each irregular word."""
    s = F.col("term")
    own = F.when(s.rlike("^[A-Za-z]{3,}$"), F.concat(F.lit('"'), _prefix(s), F.lit('"*'))).otherwise(F.concat(F.lit('"'), s, F.lit('"')))
    odd = F.array(*(F.when(s == b, F.lit(f'"{a}"')) for a, b in IRREGULAR.items()))
    return stems.select("term", F.explode(F.concat(F.array(own), F.filter(odd, lambda x: x.isNotNull()))).alias("clause"))


def candidates(docs: DataFrame, prefixes: list[str], exact: list[str] = (), text: str = "text") -> DataFrame:
    """The documents with a token that begins with a prefix or is one of `exact`: recall only, no order."""
    hit = lambda t: t.isin(list(exact)) | F.exists(F.array(*map(F.lit, prefixes)), lambda p: t.startswith(p))
    return docs.where(F.exists(tokenize(F.col(text)), hit))


def dot(a: Column, b: Column) -> Column:
    """Of vectors of different widths the shorter one's components count."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def compensated(a: Column, b: Column) -> Column:
    """The dot product with the rounding errors of the sum added at the end."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), start, step, lambda acc: acc["s"] + acc["c"])


def ranked(df: DataFrame, channel: str, kind: str, id_col: str, k: int) -> DataFrame:
    """(channel, kind, id, rank, score) of a channel's k best rows; ranks are given to k rows, not to the corpus."""
    top = df.orderBy(F.desc("score"), id_col).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), id_col))
    return top.select(F.lit(channel).alias("channel"), F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"), rank.alias("rank"), "score")


def rrf(hits: DataFrame, k: float = 60.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(kind, id, score, channels, best) of ranked hits: the sum of weight / (k + rank) of each kind and id. A channel
    without a weight of its own has the weights' mean, or 1 where there are none. best is the channels' largest score."""
    weight = F.lit(1.0)
    if weights:
        neutral = sum(weights.values()) / len(weights)
        weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in weights.items() for x in p)), F.col("channel")), F.lit(neutral))
    own = hits.groupBy("kind", "id").agg(F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"), F.max("score").alias("best"))
    return own


def interleaved(hits: DataFrame, order: list[str], k: int) -> DataFrame:
    """(kind, id, place, score, channels): the channels' hits in turn, each kind and id once; score is 1 / place."""
    nth = F.array_position(F.array(*map(F.lit, order)), F.col("channel"))
    own = hits.groupBy("kind", "id").agg(F.min(F.struct("rank", nth.alias("nth"))).alias("at"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"))
    top = own.orderBy("at.rank", "at.nth").limit(k)
    place = F.row_number().over(Window.orderBy("at.rank", "at.nth"))
    return top.select("kind", "id", place.cast("long").alias("place"), (1.0 / place).alias("score"), "channels")
