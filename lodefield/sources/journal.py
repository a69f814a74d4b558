"""An append-only journal of JSON lines, one file for each append; a line cut off at a file's end does not count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(records: DataFrame, path: str) -> None:
    """Adds the records (cid and more). Earlier files are not touched: a failed append leaves them as they were."""
    if "cid" not in records.columns:
        raise ValueError("journal records must carry a cid")
    records.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records; lines that are no JSON, as a crash leaves at an end, are left out. damaged() counts them."""
    lines = spark.read.text(path).select(F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return lines.where("r._corrupt is null and r.cid is not null").select("r.*").drop("_corrupt")


def damaged(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).select(F.from_json("value", "cid string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r._corrupt is not null or r.cid is null").count()


def divergence(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """(side, cid) of ids that the journal or the ledger has alone."""
    a, b = journal.select("cid").distinct(), ledger.select("cid").distinct()
    missing = b.join(a, "cid", "left_anti").select(F.lit("missing_from_journal").alias("side"), "cid")
    return missing.union(a.join(b, "cid", "left_anti").select(F.lit("journal_only").alias("side"), "cid"))


def purge(spark: SparkSession, path: str, to: str, schema: str, cids: DataFrame) -> None:
    """A copy of the journal in `to` without the cids."""
    append(read(spark, path, schema).join(cids.select("cid"), "cid", "left_anti"), to)
