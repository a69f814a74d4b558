"""Hierarchical weighted hash tree: region, rack and shard are each drawn by weighted hashes. Built-in functions only.

At each level every child draws ln(u) / weight with u from a hash of key and child, and the largest draw wins; a node
weighs what its shards weigh. A changed weight moves rows only into or out of the subtrees whose weight changed. Growth
opens a region of its own, so that no other node's weight changes and the new shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 4) -> tuple[Shard, ...]:
    """A tree of equal shards, numbered from 0 in the order of regions and racks."""
    return tuple(Shard(i // (racks * per_rack), i // per_rack, i) for i in range(shards))


def grown(own: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, in a rack and a region of its own."""
    return (*own, Shard(*(1 + max(getattr(s, k) for s in own) for k in ("region", "rack", "shard")), weight))


def _winner(key: Column, level: str, children: Column) -> Column:
    """Of children, an array of (child, weight), the one with the largest draw; of equal draws the smallest child."""

    def draw(c: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), c["child"]), 11) + 1) / F.lit(float(1 << 53))
        return F.struct((F.log(unit) / c["weight"]).alias("draw"), (-c["child"]).alias("child"))

    return -F.array_max(F.transform(children, draw))["child"]


def _children(nodes: dict[int, float]) -> Column:
    return F.array(*(F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in sorted(nodes.items()) if w > 0))


def place(key: Column, own: tuple[Shard, ...]) -> dict[str, Column]:
    """The columns region, rack and shard of a key, each made of the one before. A null key draws like any other value;
    nodes of weight 0 get nothing."""
    weights: dict[str, dict[int, dict[int, float]]] = {"region": {0: {}}, "rack": {}, "shard": {}}
    for s in own:
        for level, up, node in (("region", 0, s.region), ("rack", s.region, s.rack), ("shard", s.rack, s.shard)):
            at = weights[level].setdefault(up, {})
            at[node] = at.get(node, 0.0) + s.weight

    def below(up: str, level: str) -> Column:
        lists = [x for node, kids in sorted(weights[level].items()) if sum(kids.values()) > 0 for x in (F.lit(node), _children(kids))]
        return _winner(key, level, F.element_at(F.create_map(*lists), F.col(up)))

    return {"region": _winner(key, "region", _children(weights["region"][0])), "rack": below("region", "rack"), "shard": below("rack", "shard")}


def placed(df: DataFrame, key: str, own: tuple[Shard, ...]) -> DataFrame:
    """df with region, rack and shard (int); columns of these names are replaced."""
    for name, column in place(F.col(key), own).items():
        df = df.withColumn(name, column.cast("int"))
    return df


def shard_documents(docs: DataFrame, own: tuple[Shard, ...], more: tuple[Shard, ...], bucket_rows: int = 20_000, few: int = 1_000_000) -> DataFrame:
    """Every document's shard, its slot there, and its shard in the tree `more`.

    Needs doc_id and text; other columns are not read. A null text has size 16 and the crc32 of no bytes, 0. Repeated rows
    get slots of their own, rows without a doc_id go to one shard. No rows: no rows. Rows are placed and written once, in
    light form. Slots count from 0 in each shard: by a bucket of doc_id and of the part of the table that the row came
    in, and by doc_id in it; there are as many buckets as hold some bucket_rows each, so that no task grows with the
    table, nor with a doc_id that occurs often. What precedes a bucket is summed over one row for each bucket, broadcast
    up to `few` of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    rows = placed(rows, "doc_id", more).withColumnRenamed("shard", "grown_shard")
    rows = cut(placed(rows, "doc_id", own), "shards")
    buckets = max(256, rows.count() // (bucket_rows * len(own)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "part"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")))
    rows = rows.join(F.broadcast(sums) if buckets * len(own) <= few else sums, ["shard", "bucket"])
    slot = (F.col("before") + F.col("nth") - 1).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", slot.alias("slot"), "grown_shard")
