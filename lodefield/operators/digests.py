"""Digests of all ids of a group, in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many ids are joined before they go to their group's task.
JOINED = 1 << 16


def ids_sha256(rows: DataFrame, group: str, id_: str, joined: int = JOINED) -> DataFrame:
    """(group, sha256) of each group's ids as strings, sorted and joined by commas; null ids are passed over, repeated ones
    stay. Ids are sorted by ranges and joined by the thousands there; a group's pieces, in order, run through one hash in one
    task, which the digest demands, and no task holds them all."""
    kind = dict(rows.dtypes)[group]
    ids = rows.select(F.col(group).alias("g"), F.col(id_).cast("string").alias("id"))
    own = ids.where("id is not null").repartitionByRange("g", "id").sortWithinPartitions("g", "id")
    schema = pa.schema([("g", pa.string()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.string())])

    def join(batches) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        now, held = None, []
        for batch in batches:
            out = []
            for g, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (g != now or len(held) == joined):
                    out.append({"g": now, "part": part, "nth": nth, "ids": ",".join(held)})
                    nth, held = nth + 1, []
                now = g
                held.append(i)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"g": now, "part": part, "nth": nth, "ids": ",".join(held)}], schema=schema)

    def digest(batches) -> Iterator[pa.RecordBatch]:
        rows = ((g, ids) for b in batches for g, ids in zip(b.column(0).to_pylist(), b.column(3).to_pylist()))
        for g, pieces in groupby(rows, lambda r: r[0]):
            state, first = hashlib.sha256(), True
            for _, ids in pieces:
                state.update((ids if first else "," + ids).encode())
                first = False
            yield pa.RecordBatch.from_pylist([{"g": g, "sha256": state.hexdigest()}], schema=pa.schema([("g", pa.string()), ("sha256", pa.string())]))

    # Groups are compared as strings from here on; a null group stays null.
    pieces = own.select(F.col("g").cast("string"), "id").mapInArrow(join, "g string, part int, nth long, ids string")
    found = pieces.repartition("g").sortWithinPartitions("g", "part", "nth").mapInArrow(digest, "g string, sha256 string")
    every = ids.select("g").distinct()
    found = every.join(found.withColumnRenamed("g", "s"), F.col("g").cast("string").eqNullSafe(F.col("s")), "left")
    return found.select(F.col("g").cast(kind).alias(group), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))
