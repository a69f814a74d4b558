"""A stored index of terms, kept up to date batch by batch and read by a query's terms alone.

    postings  (keys, carried columns, term, tf, len), by in_batch and head (a term's first letter or digit, or `other`),
              dealt out and sorted by term and key: a filter on terms prunes folders, and row groups by their bounds
    docs      (keys, carried columns, len), by in_batch
    stale     (keys, old_batch) of documents that the batch replaces or takes back, by in_batch
    counts    one row for each batch: documents and tokens that came, and that went

A batch is identified by its number. Writing it again, as after a failure, replaces what it wrote before, and later batches
win over earlier ones. A document of a batch that comes again in a later one is replaced as a whole. Rows of an equal key in
one batch are documents each. compacted() writes what is live as one batch elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IRREGULAR, let, query_terms, stem, tokenize
from . import passages as P
from .lineage import dropped, exists, new_path, written
from .retrieval import _prefix

BATCH, HEAD = "in_batch", "head"
#: Tokens of a range of postings, so that its sort stays in memory however many there are.
MOST_SORTED = 1 << 20


def head(term: Column) -> Column:
    return F.concat(F.lit("h_"), F.when(term.rlike("^[a-z0-9]"), F.left(term, F.lit(1))).otherwise("other"))


def runs(tokens: Column) -> Column:
    """(term, tf) of a text's distinct tokens, in order: one sort and one pass."""

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("tf"))))

    return let(F.array_sort(tokens), of)


def _write(df: DataFrame, path: str, batch: int, *by: str) -> None:
    df.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH, *by).parquet(path, compression="zstd")


def _read(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    at = f"{path}/{table}"
    return spark.read.parquet(at) if exists(spark, at) else None


def sorted_(postings: DataFrame, keys: tuple[str, ...], tokens: int) -> DataFrame:
    """postings of so many tokens dealt by ranges of term and key, so that no term is one task's, and sorted by head, term
    and key."""
    own = postings.repartitionByRange(1 + tokens // MOST_SORTED, "term", *keys).withColumn(HEAD, head(F.col("term")))
    return own.sortWithinPartitions(HEAD, "term", *keys)


def add(docs: DataFrame, path: str, batch: int, keys: tuple[str, ...] = ("doc_id",), text: str = "text", carry: tuple[str, ...] = ()) -> None:
    """Takes docs into the index at path as the batch of that number. Keys must not be null; a null text has no terms."""
    of = let(tokenize(F.col(text)), lambda t: F.struct(F.size(t).alias("len"), runs(t).alias("terms")))
    rows = written(docs.select(*keys, *carry, of.alias("of")).select(*keys, *carry, "of.len", "of.terms"), "tokens", "zstd")
    retire(rows.select(*keys), path, batch, keys, rows)
    _write(rows.drop("terms"), f"{path}/docs", batch)
    own = rows.select(*keys, *carry, "len", F.explode("terms").alias("t")).select(*keys, *carry, "t.term", "t.tf", "len")
    _write(sorted_(own, keys, rows.agg(F.sum("len")).first()[0] or 0), f"{path}/postings", batch, HEAD)
    dropped(rows)


def retire(gone: DataFrame, path: str, batch: int, keys: tuple[str, ...] = ("doc_id",), come: DataFrame | None = None) -> None:
    """Takes documents (keys) of earlier batches back. come: those that the batch has itself (len)."""
    spark, old = gone.sparkSession, _read(gone.sparkSession, path, "docs")
    went = None
    if old is not None:
        stale = _read(spark, path, "stale")
        old = old.where(F.col(BATCH) < batch).join(gone.select(*keys).distinct(), list(keys), "left_semi").withColumnRenamed(BATCH, "old_batch")
        if stale is not None:
            old = old.join(stale.where(F.col(BATCH) < batch).select(*keys, "old_batch"), [*keys, "old_batch"], "left_anti")
        old = written(old.select(*keys, "old_batch", "len"), "stale")
        _write(old.select(*keys, "old_batch").distinct(), f"{path}/stale", batch)
        went = old
    number = lambda df, n, total: df.agg(F.count(F.lit(1)).alias(n), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias(total))
    none = spark.range(0).select(F.lit(0).alias("len"))
    _write(number(none if come is None else come, "n", "tokens").join(number(none if went is None else went, "n_gone", "tokens_gone")), f"{path}/counts", batch)
    if went is not None:
        dropped(went)


def live(spark: SparkSession, path: str, table: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The postings or docs that no later batch has replaced or taken back."""
    own, stale = spark.read.parquet(f"{path}/{table}"), _read(spark, path, "stale")
    if stale is None:
        return own
    return own.join(stale.select(*keys, F.col("old_batch").alias(BATCH)).distinct(), [*keys, BATCH], "left_anti")


def counts(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many documents and tokens are live: a row for each batch is read."""
    c = spark.read.parquet(f"{path}/counts").agg(F.sum(F.col("n") - F.col("n_gone")), F.sum(F.col("tokens") - F.col("tokens_gone"))).first()
    return int(c[0] or 0), int(c[1] or 0)


def counted(spark: SparkSession, path: str, within: DataFrame) -> tuple[int, int]:
    """counts() of the documents of within (doc_id)."""
    c = live(spark, path, "docs").join(within.select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)), F.sum("len")).first()
    return int(c[0]), int(c[1] or 0)


def frequencies(spark: SparkSession, path: str, terms: list[str], within: DataFrame | None = None) -> DataFrame:
    """(term, df) of those terms that any live document, or any of within, has."""
    own = of_terms(spark, path, [], sorted(set(terms)))
    own = own if within is None else own.join(within.select("doc_id"), "doc_id", "left_semi")
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def of_terms(spark: SparkSession, path: str, prefixes: list[str], exact: list[str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Live postings of terms that begin with a prefix or are one of exact: only their folders and row groups are read. An
    empty prefix reads all."""
    heads = {f"h_{x[0]}" if x[0].isascii() and (x[0].isdigit() or x[0].islower()) else "h_other" for x in [*prefixes, *exact] if x}
    hit = F.col("term").isin(list(exact)) if exact else F.lit(False)
    for p in prefixes:
        hit = hit | F.col("term").startswith(p)
    own = live(spark, path, "postings", keys)
    return own.where(hit) if "" in prefixes else own.where(F.col(HEAD).isin(sorted(heads)) & hit)


def asked(spark: SparkSession, query: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """A query's tokens, its stems (as often as they occur), what words of these stems begin with, and irregular words of
    them."""
    q = tokenize(F.lit(query))
    r = spark.range(1).select(q.alias("t"), query_terms(q).alias("s")).select("t", "s", F.transform(F.array_distinct("s"), _prefix).alias("p")).first()
    return list(r["t"]), list(r["s"]), sorted(set(r["p"])), sorted(a for a, b in IRREGULAR.items() if b in r["s"])


def bm25(spark: SparkSession, path: str, query: str, k1: float = 1.2, b: float = 0.75, within: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) as retrieval.bm25() has them over the live documents, or over those of within (doc_id) alone."""
    _, stems, heads, odd = asked(spark, query)
    n, tokens = counts(spark, path) if within is None else counted(spark, path, within)
    if not stems or not n:
        return spark.createDataFrame([], "doc_id long, score double")
    wanted = {s: stems.count(s) for s in stems}
    qtf = F.create_map(*(F.lit(x) for p in wanted.items() for x in p))
    own = of_terms(spark, path, heads, odd).withColumn("stem", stem(F.col("term"))).where(F.col("stem").isin(list(wanted)))
    own = own if within is None else own.join(within.select("doc_id"), "doc_id", "left_semi")
    own = own.groupBy("doc_id", BATCH, "stem", "len").agg(F.sum("tf").alias("tf"))
    df = own.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has stems
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.try_element_at(qtf, F.col("stem")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(tokens / n)))
    return own.join(F.broadcast(df), "stem").groupBy("doc_id").agg(F.sum(part).alias("score"))


def lexical(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(doc_id, score) of the documents with a term of the query, as retrieval.lexical() has them."""
    tokens = asked(spark, query)[0]
    if not tokens:
        return spark.createDataFrame([], "doc_id long, score double")
    times = F.create_map(*(F.lit(x) for t in dict.fromkeys(tokens) for x in (t, tokens.count(t))))
    part = F.try_element_at(times, F.col("term")) * (1 + F.log(F.col("tf").cast("double"))) / F.sqrt(F.greatest("len", F.lit(1)))
    return of_terms(spark, path, [], sorted(set(tokens))).groupBy("doc_id").agg(F.sum(part).alias("score"))


def candidates(spark: SparkSession, path: str, prefixes: list[str], exact: list[str] = ()) -> DataFrame:
    """(doc_id) of the documents with a term that begins with a prefix or is one of exact."""
    return of_terms(spark, path, list(prefixes), list(exact)).select("doc_id").distinct()


def term_stats(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, tf) of all live postings."""
    return live(spark, path, "postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def add_turns(turns: DataFrame, path: str, batch: int) -> None:
    """Takes conversations (conv_id, turn, role, text) in by their turns. A conversation comes whole: one that has grown
    comes again."""
    add(P.rounds(turns), path, batch, ("conv_id", "turn"), carry=("role", "round"))


def passage_scores(spark: SparkSession, path: str, query: str, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """passages.scores() from an index of turns."""
    keys = ("conv_id", "turn")
    tokens = asked(spark, query)[0]
    stems = [r["s"] for r in spark.range(1).select(F.explode(F.transform(F.array(*map(F.lit, tokens)).cast("array<string>"), stem)).alias("s")).distinct().collect()]
    heads = [r["p"] for r in spark.range(1).select(F.explode(F.transform(F.array(*map(F.lit, stems)).cast("array<string>"), _prefix)).alias("p")).distinct().collect()]
    hits = of_terms(spark, path, heads, sorted({*tokens, *(a for a, b in IRREGULAR.items() if b in stems)}), keys)
    own = live(spark, path, "docs", keys).select("conv_id", "turn", "role", "round", "len")
    return P.scored(own, hits.select("conv_id", "round", "turn", "role", "term", F.col("tf").alias("n")), query, alpha, beta)


def compacted(spark: SparkSession, path: str, to: str, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Writes what is live as batch 0 of a new index."""
    own, docs = live(spark, path, "postings", keys).drop(BATCH, HEAD), live(spark, path, "docs", keys).drop(BATCH)
    n, tokens = counts(spark, path)
    _write(docs, f"{to}/docs", 0)
    _write(sorted_(own, keys, tokens), f"{to}/postings", 0, HEAD)
    _write(spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(tokens).cast("long").alias("tokens"), F.lit(0).cast("long").alias("n_gone"), F.lit(0).cast("long").alias("tokens_gone")), f"{to}/counts", 0)


_KEPT: dict[tuple, str] = {}


def kept(docs: DataFrame, source: str, take=add) -> str:
    """The index of the files of a table, built the first time that this application asks for it."""
    spark = docs.sparkSession
    mark = (spark.sparkContext.applicationId, source, take.__name__, *sorted(docs.inputFiles()))
    if mark not in _KEPT or not exists(spark, f"{_KEPT[mark]}/counts"):
        path = new_path(spark, "index")
        take(docs, path, 0)
        _KEPT[mark] = path
    return _KEPT[mark]
