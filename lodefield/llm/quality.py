"""Quality rules judged by host: a host's rate of failing documents, shrunk by a beta prior fitted to all hosts, decides
how strictly the host's documents are held to the soft rules. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, cut, packed


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    # Soft rules: mean length of words, symbols for 100 words, repeated lines and repeated words for 100.
    mean_low: float = 2.0
    mean_high: float = 15.0
    symbol_percent: float = 10.0
    line_percent: float = 30.0
    soft_repeat_percent: float = 20.0
    #: A document that breaks so many soft rules goes whatever its host is.
    most_soft: int = 3
    #: A host of a higher shrunk rate is strict: its documents may break no soft rule.
    host_rate: float = 0.5


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column, n: int) -> Column:
    """Words in windows of n words that occur twice or more. Windows are compared by 64-bit hashes."""

    def covered(marked: Column) -> Column:
        """marked: (hash, position) in ascending order."""
        behind = F.concat(F.slice(marked, 2, F.size(marked)), F.array(F.lit(None)))
        ahead = F.concat(F.array(F.lit(None)), F.slice(marked, 1, F.size(marked) - 1))
        twin = F.zip_with(marked, behind, lambda x, y: F.struct(x["h"].alias("h"), x["p"].alias("p"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("t")))
        twin = F.zip_with(twin, ahead, lambda x, y: F.when(x["t"] | F.coalesce(x["h"] == y["h"], F.lit(False)), x["p"]))
        at = F.array_sort(F.filter(twin, lambda p: p.isNotNull()))
        gaps = let(at, lambda a: F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.least(F.lit(n), F.coalesce(y - x, F.lit(n)))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).otherwise(0))
    return F.when(F.size(words) >= n, found).otherwise(0)


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs and the columns n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long), base_failed and
    soft_failed (how many soft rules it breaks); columns of these names are replaced. A null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)).alias("chars"), _covered(w, rules.window).alias("again")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    at = docs.withColumn("quality_w", of_words).withColumn("quality_l", of_lines).withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    # Nothing is computed twice if these stay apart from what is made of them.
    for name, of in (("n_words", "quality_w.n"), ("word_chars", "quality_w.chars"), ("n_dup_lines", "quality_l.again"), ("n_lines", "quality_l.n"), ("n_repeat_words", "quality_w.again")):
        at = at.withColumn(name, F.col(of).cast("long"))
    return at.drop("quality_w", "quality_l")


def flagged(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measured rows with base_failed and soft_failed. No rows: no rows; a text without words has base_failed true."""
    n = F.col("n_words")
    soft = [
        (F.col("word_chars") < rules.mean_low * n) | (F.col("word_chars") > rules.mean_high * n),
        100 * F.col("n_symbols") > rules.symbol_percent * n,
        100 * F.col("n_dup_lines") > rules.line_percent * F.col("n_lines"),
        100 * F.col("n_repeat_words") > rules.soft_repeat_percent * n,
    ]
    df = df.withColumn("base_failed", (n < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * n))
    return df.withColumn("soft_failed", sum(x.cast("int") for x in soft))


def hosts(df: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """(host, host_docs, host_rate, strict) of each host in flagged rows. The prior is fitted by the moments of all
    hosts' rates; where they do not differ it weighs 1000 documents. A null host is a host too."""
    own = df.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum((F.col("base_failed") | (F.col("soft_failed") > 0)).cast("long")).alias("failed"))
    own = cut(own, "hosts")
    rate = F.col("failed") / F.col("host_docs")
    mean, var = own.agg(F.avg(rate), F.var_pop(rate)).first()
    mean = mean or 0.0
    size = min(1000.0, max(1.0, mean * (1 - mean) / var - 1)) if var else 1000.0
    shrunk = (F.col("failed") + F.lit(mean * size)) / (F.col("host_docs") + F.lit(size))
    return own.select("host", "host_docs", shrunk.alias("host_rate")).withColumn("strict", F.col("host_rate") > rules.host_rate)


def judged(df: DataFrame, host: str, rules: Rules = Rules(), most_hosts: int = 100_000) -> DataFrame:
    """Flagged rows with host_docs, host_rate and kept (columns of these names must not be there). Verdicts are broadcast
    up to most_hosts hosts. A null host is a host too; a host of one document is judged by the prior for the most part."""
    verdicts = hosts(df, host, rules)
    side = F.broadcast(verdicts) if verdicts.limit(most_hosts + 1).count() <= most_hosts else verdicts
    soft = F.col("soft_failed")
    kept = ~F.col("base_failed") & (soft < rules.most_soft) & ~(F.coalesce(F.col("strict"), F.lit(False)) & (soft > 0))
    joined = df.join(side.withColumnRenamed("host", "quality_host"), F.col(host).eqNullSafe(F.col("quality_host")), "left")
    return joined.withColumn("kept", kept).drop("quality_host", "strict")


def rate_documents(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Every document's measures and verdict. Needs doc_id, text and the host column; repeated rows are judged each."""
    rows = cut(measured(docs.select("doc_id", host, "text"), rules).drop("text"), "quality")
    out = judged(flagged(rows, rules), host, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, in the columns that came in, whatever their names. Needs text and the host column.
    A null or empty text is rejected, repeated rows are judged each. No rows: no rows."""
    own = docs.select(packed(docs, "quality_row"), F.col(host).alias("quality_of"), F.col("text").alias("text"))
    rows = cut(measured(own, rules).drop("text"), "quality")
    return judged(flagged(rows, rules), "quality_of", rules).where("kept").select("quality_row.*")
