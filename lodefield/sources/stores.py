"""Whole stores as JSON, blobs by their hash, filtered exports, change feeds, Markdown blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def persist(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each collection."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def put_blobs(df: DataFrame, content: str, path: str) -> None:
    """Adds contents that the store does not hold yet, each once, under its sha256, dealt to folders by its first byte."""
    spark = df.sparkSession
    new = df.select(F.sha2(F.col(content), 256).alias("cid"), F.col(content).cast("binary").alias("content")).where("content is not null").dropDuplicates(["cid"])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(blobs(spark, path).select("cid"), "cid", "left_anti")
    new.withColumn("head", F.substring("cid", 1, 1)).write.mode("append").partitionBy("head").parquet(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cid string, content binary, head string").parquet(path).select("cid", "content")


def damaged_blobs(spark: SparkSession, path: str) -> DataFrame:
    return blobs(spark, path).where(F.sha2("content", 256) != F.col("cid")).select("cid")


def export(rows: DataFrame, path: str, tenant: str, redacted: dict[str, str] | None = None) -> None:
    """The tenant's rows as JSON, with some columns' values replaced by fixed texts."""
    out = rows.where(F.col("tenant") == tenant)
    for name, text in (redacted or {}).items():
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), F.lit(text)))
    out.write.mode("overwrite").json(path)


def changes(feed: DataFrame, after: int, revision: str = "revision") -> DataFrame:
    """What changed since a revision, in its order."""
    return feed.where(F.col(revision) > after).orderBy(revision)


def blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, nth, heading, body) of Markdown texts: a block is a heading and all up to the next; what stands before the first
    heading has none."""
    marked = F.split(F.regexp_replace(F.col(text), r"(?m)^(#{1,6}\s)", "\x02$1"), "\x02")
    parts = F.filter(F.transform(marked, lambda b: F.trim(b)), lambda b: b != "")
    heading = F.regexp_extract("block", r"^#{1,6}\s+([^\n]*)", 1)
    return texts.select(key, F.posexplode(parts).alias("nth", "block")).select(key, "nth", F.trim(heading).alias("heading"), F.regexp_replace(F.regexp_replace("block", r"^#{1,6}\s[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def synced(held: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """held after incoming rows replaced those of their keys: columns as in held, with `effect` added, changed or kept."""
    a, b = held.withColumn("side", F.lit(0)), incoming.select(*held.columns).withColumn("side", F.lit(1))
    value = [c for c in held.columns if c not in keys]
    own = a.union(b).groupBy(*keys).agg(F.max_by(F.struct(*value), "side").alias("new"), F.min_by(F.struct(*value), "side").alias("old"), F.min("side").alias("first"))
    effect = F.when(F.col("first") == 1, "added").when(F.col("new").eqNullSafe(F.col("old")), "kept").otherwise("changed")
    return own.select(*keys, *(F.col(f"new.{c}").alias(c) for c in value), effect.alias("effect"))
