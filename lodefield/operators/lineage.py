"""Tables between the rounds of an iteration, in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
    return spark


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one a temporary folder, elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodefield-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "round", compression: str = "snappy") -> DataFrame:
    """df, written and read again: what made it is not planned or run again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lodefield_path = path
    return out


def bucketed(df: DataFrame, by: str, n: int, order: str, tag: str = "buckets") -> DataFrame:
    """df, written in n buckets by one of its columns and read again: joins on this column do not deal it out anew. Rows of
    a bucket are in order."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    name = f"lodefield_{path[-32:]}"
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).sortBy(order).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.lodefield_path, out.lodefield_table = path, name
    return out


def bucket_labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers, of which the i-th is in the i-th of n buckets."""
    rows = spark.range(64 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
    return [r["id"] for r in sorted(rows.collect())]


#: Rows up to which a written table is sent whole to a join's other side.
MOST_SENT = 100_000


def beside(df: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """df, of n rows, as one side of a join: sent whole if it has few rows, else dealt out with the other side. Files of sorted
    numbers are so small that by their size alone millions of rows would go through the driver."""
    return F.broadcast(df) if n <= (MOST_SENT if most is None else most) else df.hint("shuffle_hash")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    own = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return own.exists(at) and own.getFileStatus(at).isDirectory()


def dropped(*frames: DataFrame) -> None:
    for df in frames:
        if getattr(df, "lodefield_table", None):
            df.sparkSession.sql(f"drop table if exists {df.lodefield_table}")
        path = getattr(df, "lodefield_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
