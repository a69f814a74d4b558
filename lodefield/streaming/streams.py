"""Structured Streaming over event files: each function takes a streaming DataFrame and gives one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import postings
from ..operators.lineage import exists, is_folder, new_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: str = "events.parquet", most_files: int | None = None) -> DataFrame:
    """The stream of a folder's event table, which is a file or a folder of files, or of all files that a glob names.
    most_files: how many files a batch takes. It is an error if there is no such table."""
    reader = spark.readStream.schema(EVENTS)
    reader = reader.option("maxFilesPerTrigger", most_files) if most_files else reader
    if is_folder(spark, f"{folder}/{files}"):
        return reader.parquet(f"{folder}/{files}")
    if not any(c in files for c in "*?[{") and not exists(spark, f"{folder}/{files}"):
        raise FileNotFoundError(f"{folder}/{files}")
    return reader.option("pathGlobFilter", files).option("recursiveFileLookup", False).parquet(folder)


def drained(stream: DataFrame, mode: str = "append", batch=None) -> DataFrame:
    """Runs the stream over all there is now and gives its output as a table. batch: what foreachBatch does instead."""
    spark, at, state = stream.sparkSession, new_path(stream.sparkSession, "sink"), new_path(stream.sparkSession, "state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if batch is not None:
        writer.foreachBatch(lambda df, i: batch(df, i, at)).start().awaitTermination()
    else:
        writer.format("parquet").option("path", at).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def rows(spark: SparkSession, folder: str, name: str, most_files: int | None = None) -> DataFrame:
    """The stream of a folder's table, a file or a folder of files, with the table's own columns."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    reader = reader.option("maxFilesPerTrigger", most_files) if most_files else reader
    return reader.parquet(f"{folder}/{name}.parquet") if is_folder(spark, f"{folder}/{name}.parquet") else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def indexed(stream: DataFrame, path: str, add=postings.add) -> None:
    """Takes all that a stream of texts has now into the index at path, batch by batch; a batch that is run again, as after
    a failure, replaces what it wrote. Progress is kept beside the index, so that a later run goes on where this one ended."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    writer.foreachBatch(lambda df, i: add(df, path, i)).start().awaitTermination()


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) of sessions that the watermark has closed."""
    own = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def counts(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, value) of tumbling windows that the watermark has closed."""
    own = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


FIRED = "user_id long, occurrence long, event_id long, fired_at timestamp"


def triggers(stream: DataFrame, event_type: str, least: float, interval: str = "3 days", most: int = 5) -> DataFrame:
    """One intention for each user: it waits for an event of a type that is worth `least`; once fired it is due again
    `interval` after the time it was due, `most` times in all. The state is the count, the due time and the last signal
    that was used, so that a replayed event does not fire again."""
    step = pd.Timedelta(interval)

    def fire(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, due, used_at, used_id = state.get if state.exists else (0, None, None, None)
        out = []
        rows = pd.concat(list(batches))
        rows = rows[(rows["event_type"] == event_type) & (rows["value"] >= least)].sort_values(["ts", "event_id"])
        for r in rows.itertuples():
            at = r.ts.value // 1000
            fresh = used_at is None or (at, r.event_id) > (used_at, used_id)
            if n < most and fresh and (due is None or at >= due):
                out.append((key[0], n, r.event_id, r.ts))
                n, due, used_at, used_id = n + 1, (at if due is None else due) + step.value // 1000, at, r.event_id
        state.update((n, due, used_at, used_id))
        yield pd.DataFrame(out, columns=["user_id", "occurrence", "event_id", "fired_at"])

    return stream.groupBy("user_id").applyInPandasWithState(fire, FIRED, "n long, due long, used_at long, used_id long", "append", GroupStateTimeout.NoTimeout)


def working_memory(rows: DataFrame, now: str, ttl: str, capacity: int) -> DataFrame:
    """The items of each user that have not run out by `now`, the latest `capacity` of them (a table, or a batch of a
    stream)."""
    from pyspark.sql import Window

    live = rows.where(F.col("ts") + F.expr(f"interval {ttl}") > F.to_timestamp(F.lit(now)))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return live.withColumn("memory_rank", F.row_number().over(w)).where(F.col("memory_rank") <= capacity).drop("memory_rank")


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark, for sources that deliver again."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
