"""A content-addressed store of documents' token ids.

    chunks/     digest (blake2b of 16 bytes), size, payload: each distinct chunk once, ids little-endian, 2 or 4 bytes each
    recipes/    part, doc_id, n_tokens, root, digests, sizes: a document's chunks, files and rows in ascending doc_id order
    manifest/   level, node, digest: a Merkle tree over the documents' roots in that order, 1024 children to a node

A chunk ends where a rolling hash of the last 16 ids has its low bits zero, after 4096 ids, and at the document's end, so
that copies and shared passages give the same chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import delete, mixed, ready
from .tokens import encode, known, tokenizer

WINDOW, MEAN_BITS, LONGEST, FAN = 16, 9, 4096, 1024


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end, in ascending order, given where documents end. No chunk spans two documents."""
    roll = mixed(ids + np.uint64(1)) if len(ids) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        width, power = 1, np.uint64(0x9E3779B97F4A7C15)
        while width < WINDOW:
            older = np.zeros_like(roll)
            older[width:] = roll[:-width]
            roll = roll + power * older
            width, power = width * 2, power * power
    at = np.flatnonzero((roll >> np.uint64(64 - MEAN_BITS)) == 0) + 1
    first = np.concatenate(([0], ends))[np.searchsorted(ends, at, side="left")]
    at = np.unique(np.concatenate((at[at - first >= WINDOW], ends)))
    gap = np.diff(at, prepend=0)
    if len(gap) and gap.max() > LONGEST:
        more = [np.arange(b - g + LONGEST, b, LONGEST) for b, g in zip(at[gap > LONGEST], gap[gap > LONGEST])]
        at = np.unique(np.concatenate((at, *more)))
    return at[at > 0]


def write_store(docs: DataFrame, to: str, path: str, end_id: int = 2) -> None:
    """Encodes every whole text, appends end_id and writes the store to the folder `to`, which executors must share.

    Needs doc_id and text. A null or empty text is end_id alone; repeated rows are documents each; nulls come first in
    the order of doc_id, and rows of equal doc_id stand in the order of their roots.
    """
    spark = ready(docs.sparkSession)

    def run(batches):
        width = "<u2" if tokenizer(path)[0].get_vocab_size() <= 1 << 16 else "<u4"
        seen, met = set(), known(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, size = encode(part.column(1), path, met)
                ids = np.insert(ids, np.cumsum(size), np.uint32(end_id))
                ends = np.cumsum(size + 1)
                at = cuts(ids, ends)
                raw, narrow = ids.astype(width), np.dtype(width).itemsize
                view = memoryview(raw.tobytes())
                from_, n = np.concatenate(([0], at[:-1])) * narrow, at * narrow
                digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(from_.tolist(), n.tolist())]
                sizes = np.diff(at, prepend=0).astype(np.int32)
                of = np.searchsorted(at, ends)  # the last chunk of each document
                lows, keys, roots, lists, own = np.concatenate(([0], of[:-1] + 1)).tolist(), [], [], [], []
                for a, b in zip(lows, (of + 1).tolist()):
                    lists.append(b"".join(digests[a:b]))
                    own.append(sizes[a:b].tobytes())
                    roots.append(hashlib.blake2b(lists[-1], digest_size=16).digest())
                fresh = []
                for i, d in enumerate(digests):
                    if d not in seen:
                        seen.add(d)
                        fresh.append(i)
                if len(seen) > 1 << 18:  # only saves shuffling; what is left is found behind the shuffle
                    seen.clear()
                keys = [digests[i] for i in fresh]
                m, k = len(roots), len(fresh)
                none = lambda kind, n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["recipes"] * m + ["chunks"] * k),
                        pa.array(roots + keys, pa.binary()),
                        pa.concat_arrays([part.column(0).cast(pa.int64()), none(pa.int64(), k)]),
                        pa.array(np.concatenate((size + 1, sizes[fresh].astype(np.int64)))),
                        pa.array(lists + [bytes(view[from_[i] : n[i]]) for i in fresh], pa.binary()),
                        pa.array(own + [None] * k, pa.binary()),
                    ],
                    names=["kind", "digest", "doc_id", "size", "payload", "sizes"],
                )

    def once(batches):
        """Behind the shuffle all rows of a digest are in one task."""
        seen: set[bytes] = set()
        for batch in batches:
            chunk = np.asarray(pa.compute.equal(batch.column(0), "chunks"))
            keep = np.ones(len(chunk), bool)
            for i, d in enumerate(batch.column(1).to_pylist()):
                if chunk[i]:
                    keep[i] = d not in seen
                    seen.add(d)
            yield batch.filter(pa.array(keep))

    schema = "kind string, digest binary, doc_id long, size long, payload binary, sizes binary"
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
    # The recipes of one root (a group of copies) are spread by doc_id; chunks are dealt by digest alone.
    spread = F.when(F.col("kind") == "recipes", F.xxhash64("doc_id")).otherwise(F.lit(0))
    rows = rows.repartition("digest", spread).mapInArrow(once, schema)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{to}/new")
    new = spark.read.schema(schema).parquet(f"{to}/new")
    recipes = new.where("kind = 'recipes'").selectExpr("doc_id", "size n_tokens", "digest root", "payload digests", "sizes")
    recipes = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    recipes.write.option("compression", "zstd").parquet(f"{to}/recipes")
    delete(spark, f"{to}/new/kind=recipes")
    _merkle(numbered(spark, to)).write.parquet(f"{to}/manifest")


def chunks(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("digest binary, size long, payload binary, kind string").parquet(f"{at}/new").where("kind = 'chunks'").drop("kind")


def numbered(spark: SparkSession, at: str) -> DataFrame:
    """The recipes with each document's rank and the number of ids before it: sums within files onto sums of files."""
    recipes = spark.read.schema("doc_id long, n_tokens long, root binary, digests binary, sizes binary, part int").parquet(f"{at}/recipes")
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs"))
    inside = Window.partitionBy("part").orderBy("doc_id", "root")
    recipes = recipes.withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    return recipes.join(F.broadcast(parts), "part").select("doc_id", "n_tokens", "root", "digests", "sizes", (F.col("ids") + F.col("upto") - F.col("n_tokens")).alias("start"), (F.col("docs") + F.col("nth") - 1).alias("rank"))


def _merkle(ranked: DataFrame) -> DataFrame:
    """All levels of the tree, up to the one that has a single node for any number of documents up to 1024 ** 4."""
    now = ranked.select(F.col("rank").alias("node"), F.hex("root").alias("digest"))
    levels = []
    for level in range(1, 5):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), "")
        now = now.groupBy((F.col("node") / FAN).cast("long").alias("up")).agg(F.sha2(joined, 256).alias("digest")).select(F.col("up").alias("node"), "digest")
        levels.append(now.select(F.lit(level).alias("level"), "node", "digest"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def _fits(spark: SparkSession, at: str, ranked: DataFrame) -> bool:
    """Whether the tree over the documents' roots, made anew from their lists of digests, is that of the manifest."""

    def rooted(batches):
        for batch in batches:
            roots = [hashlib.blake2b(d, digest_size=16).digest() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.binary())], names=["rank", "root"])

    now = _merkle(ranked.select("rank", "digests").mapInArrow(rooted, "rank long, root binary"))
    was = spark.read.schema(now.schema).parquet(f"{at}/manifest")
    return was.exceptAll(now).union(now.exceptAll(was)).isEmpty()


def _shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The crc32 of texts followed by n zero bytes, as far as it depends on the texts' own: x ** (8 n) modulo the polynomial."""
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    step = np.zeros(32, np.uint32)  # what one zero bit makes of each bit
    step[0], step[1:] = 0xEDB88320, np.uint32(1) << np.arange(31, dtype=np.uint32)

    def times(matrix, x):
        y = np.zeros_like(x)
        for j in range(32):
            y ^= np.where((x >> np.uint32(j)) & np.uint32(1), matrix[j], np.uint32(0)).astype(np.uint32)
        return y

    for _ in range(3):
        step = times(step, step)
    while n.any():
        odd = (n & 1).astype(bool)
        if odd.any():
            out[odd] = times(step, out[odd])
        n >>= 1
        step = times(step, step)
    return out


def read_digests(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. Each chunk is read, held against its
    digest and summed up once; a document's crc32 is put together from those of its chunks. Recipes that aren't those of the
    manifest are an error, raised before there are rows."""
    ready(spark)
    docs = numbered(spark, at)
    if not _fits(spark, at, docs):
        raise ValueError("the recipes are not those of the manifest")
    return _digests(spark, at, docs)


def _digests(spark: SparkSession, at: str, docs: DataFrame) -> DataFrame:

    def verified(batches):
        for batch in batches:
            digests, sizes, payloads = (c.to_pylist() for c in batch.columns)
            crc = []
            for d, n, p in zip(digests, sizes, payloads):
                if hashlib.blake2b(p, digest_size=16).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                crc.append(zlib.crc32(np.frombuffer(p, "<u2" if len(p) == 2 * n else "<u4").astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), batch.column(1)], names=["digest", "crc", "has"])

    def uses(batches):
        for batch in batches:
            doc, start, n_tokens, digests, sizes = ([x.as_py() for x in c] for c in batch.columns)
            rows = {k: [] for k in ("doc_key", "digest", "size", "after")}
            for i, (d, s) in enumerate(zip(digests, sizes)):
                s = np.frombuffer(s, np.int32).astype(np.int64)
                rows["doc_key"] += [start[i]] * len(s)
                rows["digest"] += [d[k : k + 16] for k in range(0, len(d), 16)]
                rows["size"] += s.tolist()
                rows["after"] += (s.sum() - np.cumsum(s)).tolist()
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_key", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("after", pa.int64())]))

    def shift(batches):
        for batch in batches:
            crc, has, size, after = (np.asarray(batch.column(i)) for i in range(1, 5))
            if not np.array_equal(has, size):
                raise ValueError("a recipe doesn't fit its chunks")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_shifted(crc, 4 * after).astype(np.int64)), pa.array(size)], names=["doc_key", "crc", "size"])

    known = chunks(spark, at).mapInArrow(verified, "digest binary, crc long, has long")
    # start names a document: each has one id at least.
    used = docs.select("doc_id", "start", "n_tokens", "digests", "sizes").mapInArrow(uses, "doc_key long, digest binary, size long, after long")
    parts = used.join(known, "digest").select("doc_key", "crc", "has", "size", "after").mapInArrow(shift, "doc_key long, crc long, size long")
    sums = parts.groupBy("doc_key").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("found"))
    out = docs.join(sums, docs["start"] == sums["doc_key"], "left")
    whole = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document is not whole")).cast("long"))
    return out.select("doc_id", "start", "n_tokens", whole.alias("ids_crc32"), "rank")


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, ids) of every document, rebuilt from its recipe."""
    docs = numbered(spark, at).select("doc_id", "start", F.expr("transform(sequence(0, cast(length(digests) / 16 as int) - 1), i -> substring(digests, i * 16 + 1, 16))").alias("d"))
    rows = docs.select("doc_id", "start", F.posexplode("d").alias("nth", "digest")).join(chunks(spark, at), "digest")
    return rows.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("nth", "size", "payload"))).alias("c")).mapInArrow(_joined, "doc_id long, ids array<int>")


def _joined(batches):
    for batch in batches:
        doc, ids = batch.column("doc_id"), []
        for row in batch.column("c").to_pylist():
            ids.append(np.concatenate([np.frombuffer(c["payload"], "<u2" if len(c["payload"]) == 2 * c["size"] else "<u4").astype(np.int32) for c in row]))
        yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def verify(spark: SparkSession, at: str) -> bool:
    """Whether the manifest is that of the recipes as they are now, and every document can be rebuilt."""
    docs = numbered(ready(spark), at)
    return _fits(spark, at, docs) and _digests(spark, at, docs).where("ids_crc32 is null").limit(1).count() == 0
