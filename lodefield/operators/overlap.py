"""Word shingles of documents that a benchmark has too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a name is up to three capitalised words.
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"


def shingled(df: DataFrame, key: str, n: int = 8, text: str = "text") -> DataFrame:
    """(key, h) of the distinct n-word shingles, known by 64-bit hashes."""
    words = df.select(key, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0).alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))
    return words.select(key, F.explode(F.array_distinct(grams)).alias("h"))


def hits(docs: DataFrame, probes: DataFrame, few: int = 1_000_000) -> DataFrame:
    """(item_id, doc_id, h) of documents that hold a probe (item_id, h). Up to `few` probes are broadcast, so that no
    shingle of a document is shuffled but those that hit."""
    side = F.broadcast(probes) if probes.limit(few + 1).count() <= few else probes
    return shingled(docs, "doc_id").join(side, "h").select("item_id", "doc_id", "h")


def development(items: DataFrame, key: str, n: int) -> DataFrame:
    """The n items of the lowest sha256 of their key."""
    return items.select(key).orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


def contaminated(docs: DataFrame, items: DataFrame, dev: DataFrame) -> DataFrame:
    """(item_id, doc_id) of documents that hold a shingle that one held-out item alone has and no development item."""
    grams = shingled(items, "item_id")
    known = grams.join(F.broadcast(dev), "item_id", "left_semi").select("h")
    own = grams.groupBy("h").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("owners")).where("owners = 1")
    probes = own.join(F.broadcast(dev), "item_id", "left_anti").join(known, "h", "left_anti").select("item_id", "h")
    return hits(docs, probes).select("item_id", "doc_id").distinct()


def rare_names(items: DataFrame, dev: DataFrame, most: int = 2) -> DataFrame:
    """(name, owners) of capitalised names of at most `most` held-out items that no development item has, and that no
    development item writes as a word in lower case."""
    names = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), 0))).alias("name"))
    of_dev = items.join(F.broadcast(dev), "item_id", "left_semi")
    low = of_dev.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[a-z][a-z]+\b"), 0)).alias("w")).distinct()
    seen = names.join(F.broadcast(dev), "item_id", "left_semi").select("name").distinct()
    own = names.join(F.broadcast(dev), "item_id", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("owners"))
    own = own.where((F.col("owners") <= most) & (F.length("name") >= 4)).join(seen, "name", "left_anti")
    return own.join(low, ~F.col("name").contains(" ") & (F.lower("name") == F.col("w")), "left_anti")
