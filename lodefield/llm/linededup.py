"""Site-relative line frequency: a line on more than a given share of its host's pages is boilerplate and goes from them.
Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, packed

#: Tasks that a host's documents are dealt to where its lines are not broadcast.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, those with a word that stand on more than ratio of
    the host's pages and on least_pages at least. A host's list is at most its mean number of lines to a page / ratio."""
    seen = F.filter(_lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keys = F.array_distinct(F.transform(seen, lambda x: F.xxhash64(x)))
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    lines = docs.select(F.col(host).alias("host"), F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("on"))
    lines = lines.where(F.col("on") >= least_pages)
    both = lines.join(pages.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return both.where(F.col("on") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def _cleaned(docs: DataFrame, host: str, ratio: float, least_pages: int, most_lines: int, without: tuple[str, ...]) -> DataFrame:
    """dedup_row (the document's other columns), dedup_text, n_lines and n_dropped."""
    lists = boilerplate(docs, host, ratio, least_pages).withColumnRenamed("host", "dedup_host").withColumnRenamed("lines", "dedup_lines")
    lists = cut(lists, "lines")
    n = lists.agg(F.coalesce(F.sum(F.size("dedup_lines") + 8), F.lit(0))).first()[0]
    own = docs.select(packed(docs, "dedup_row", without), F.col(host).alias("dedup_of"), F.col("text").alias("dedup_in"))
    same = F.col("dedup_of").eqNullSafe(F.col("dedup_host"))
    if n <= most_lines:
        rows = own.join(F.broadcast(lists), same, "left")
    else:  # a host's documents are dealt to SALTS tasks, and its list goes to each
        salted = lists.withColumn("dedup_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("dedup_mine", F.pmod(F.xxhash64("dedup_in"), F.lit(SALTS)).cast("int"))
        rows = own.join(salted, same & (F.col("dedup_mine") == F.col("dedup_salt")), "left")
    text, has = F.col("dedup_in"), F.col("dedup_lines").isNotNull() & F.col("dedup_in").isNotNull()
    goes = lambda x: F.array_contains(F.col("dedup_lines"), F.xxhash64(x)) & x.rlike(r"[^\x20\x09-\x0D]")
    kept = F.when(has, F.array_join(F.filter(_lines(text), lambda x: ~goes(x)), "\n")).otherwise(text)
    size = F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text))).cast("long")
    dropped = F.when(has, F.size(F.filter(_lines(text), goes))).otherwise(F.lit(0)).cast("long")
    return rows.select("dedup_row", kept.alias("dedup_text"), size.alias("n_lines"), dropped.alias("n_dropped"))


def clean(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 5, most_lines: int = 2_000_000) -> DataFrame:
    """docs without boilerplate lines, with n_lines and n_dropped (columns of these names are replaced).

    Lines are what line breaks part. A null text stays null and has no lines; a text may become empty. Repeated rows are
    pages each. Lists of lines, 8 bytes each, are broadcast up to most_lines; beyond that texts are dealt
    by host and a salt. No rows: no rows.
    """
    counts = ("n_lines", "n_dropped")
    rows = _cleaned(docs, host, ratio, least_pages, most_lines, ("text", *counts))
    own = (F.col("dedup_text").alias("text") if c == "text" else F.col(f"dedup_row.`{c}`").alias(c) for c in docs.columns if c not in counts)
    return rows.select(*own, *counts)


def clean_texts(docs: DataFrame, host: str = "source", length: str = "n_chars", **more) -> DataFrame:
    """docs without boilerplate lines, in the columns that came in, whatever their names; where lines went the column
    `length`, if there is one, has the text's new length."""
    rows = _cleaned(docs, host, more.get("ratio", 0.1), more.get("least_pages", 5), more.get("most_lines", 2_000_000), ("text",))

    def column(c: str) -> Column:
        old = F.col("dedup_text") if c == "text" else F.col(f"dedup_row.`{c}`")
        if c == length:
            old = F.when(F.col("n_dropped") > 0, F.length("dedup_text").cast(dict(docs.dtypes)[c])).otherwise(old)
        return old.alias(c)

    return rows.select(*(column(c) for c in docs.columns))
