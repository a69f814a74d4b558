"""What the operators of this package have in common: the shared folder, cut lineage, words, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"


#: Python workers give back what a batch took as soon as it is freed, rather than keep it for the next stage.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_MMAP_THRESHOLD_": "4194304"}
#: Rows of an Arrow batch, where the session has not been told any: texts can be long.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started, and keeps their batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
    for name, value in WORKER.items():
        env.setdefault(name, value)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2048")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where the session names none, a temporary one on a local master;
    on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodefield-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and losing an executor costs nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lodefield_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes what cut() wrote."""
    for df in frames:
        path = getattr(df, "lodefield_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def packed(docs: DataFrame, name: str, without: tuple[str, ...] = ()) -> Column:
    """All columns of docs but some as one struct, so that columns of any name can stand beside those of an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in without)).alias(name)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased in A-Z only, and the offset of each text's first word (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # Joined with nothing, so that offsets start at 0: ascii_lower() misreads a slice's that were cast.
    texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([], pa.large_string())])
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        ends, flat = before[ends], flat.filter(pa.array(full))
    return flat, ends


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words of any batch have equal hashes."""
    import xxhash

    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    of = xxhash.xxh3_64_intdigest
    own = np.fromiter((of(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[np.asarray(coded.indices)]


def connected(edges: DataFrame, few: int = 200_000) -> DataFrame:
    """(id, root) of every id in edges (a, b), written: root is the smallest id reachable. Each round contracts every
    task's edges to stars, then lets each id adopt the smallest neighbour (large and small stars), written between rounds,
    until all that is left are stars around roots; 100 rounds without that are an error."""
    ready(edges.sparkSession)
    now = cut(edges.select("a", "b").mapInArrow(_stars, "a long, b long"), "links")
    if now.limit(few + 1).count() <= few:  # that many links fit in one task
        new = cut(now.coalesce(1).mapInArrow(lambda it: _stars(_whole(it)), "a long, b long"), "links")
        drop(now)
        now = new
    else:
        for _ in range(100):
            both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = now.select(F.col("a").alias("x"), F.col("b").alias("y"))
            # Every edge (x, y), x the root it has so far: y's neighbours and y itself hang from the least id near y.
            moved = (
                large.join(least.withColumnRenamed("a", "y"), "y").select(F.col("x").alias("a"), F.col("m").alias("b"))
                .union(least.select("a", F.col("m").alias("b")))
                .where("a != b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).select("a", "b")
            )
            new = cut(moved.mapInArrow(_stars, "a long, b long").distinct(), "links")
            drop(now)
            now = new
            n, kids = now.agg(F.count(F.lit(1)), F.countDistinct("b")).first()
            if n == kids and now.select("a").distinct().join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
                break
        else:
            raise RuntimeError("components were not found within 100 rounds")
    out = cut(now.select(F.col("b").alias("id"), F.col("a").alias("root")).union(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()), "roots")
    drop(now)
    return out


def _whole(batches):
    batches = list(batches)
    if batches:
        yield pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)[0]


def _stars(batches):
    """A task's edges as stars around the smallest id of each of its components."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(a):
            continue
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while True:
            least = root.copy()
            m = np.minimum(root[x], root[y])
            np.minimum.at(least, root[x], m)
            np.minimum.at(least, root[y], m)
            least = least[root]
            while not np.array_equal(least, least[least]):
                least = least[least]
            if np.array_equal(least, root):
                break
            root = least
        keep = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[keep]]), pa.array(ids[keep])], names=["a", "b"])
