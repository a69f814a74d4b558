"""The trie of conversations' prefixes, with what its subtrees hold, in shards of succinct level-order tries.

    1. Each conversation is rebuilt: the first h turns of the one it branches off, then its own turns after its first h.
    2. A prefix is known by its length and the xor of hashes of (position, role, text), which rolls along the turns in
       blocks, so that no task needs all turns of a conversation. Equal conversations become one, with a count.
    3. A prefix of one distinct conversation only is the tail below a leaf of the trie: what its subtree holds follows from
       running sums along that conversation. The other prefixes, shared by several, are the trie's nodes.
    4. A node under which more turns lie than an even share of the table is an upper node; shards hang from those. A
       task's shards become one LOUDS trie in numpy: bits in level order, a one for each child and a zero behind them, and
       the labels of the edges. Rollups go up its levels from the last by add.at.
    5. Shards' tops are summed by their parent, and the upper nodes, at most `most_upper`, become one more such trie. If
       there were more of them, shards may be larger, four times in each round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, ready

#: Turn numbers or positions that a window is over; bits of a conv_id's number within a list of members.
BLOCK, MEMBERS = 4096, 10
LEAST, MOST_UPPER = 64, 250_000


class Louds:
    """A level-order trie under an unnamed root: bits (a one for each child, then a zero, of the root and of each node in
    level order), the labels of the nodes' edges in level order, order (level order to the given nodes). Siblings stand in
    the order of their labels."""

    def __init__(self, parent: np.ndarray, depth: np.ndarray, label: np.ndarray):
        """parent: each node's parent among the nodes, or -1; depth: any number that grows from parent to child."""
        n = len(parent)
        level, rank = np.ones(n, np.int64), np.zeros(n, np.int64)
        by = np.argsort(depth, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(depth[by])) + 1) if n else []:
            level[own] = np.where(parent[own] >= 0, level[parent[own]] + 1, 1)
        by = np.argsort(level, kind="stable")
        order, at = [], 0
        for own in np.split(by, np.flatnonzero(np.diff(level[by])) + 1) if n else []:
            above = np.where(parent[own] >= 0, rank[parent[own]], -1)
            own = own[np.lexsort((label[own], above))]
            rank[own] = at + np.arange(len(own))
            order.append(own)
            at += len(own)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        children = np.bincount(np.where(parent >= 0, rank[parent] + 1, 0), minlength=n + 1) if n else np.zeros(1, np.int64)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(children) + np.arange(n + 1)] = False
        self.labels = label[self.order]

    def parents(self) -> np.ndarray:
        """Of each node in level order: 0 is the root, i + 1 the node i."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def children(self) -> np.ndarray:
        """How many the root and each node have."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def find(self, labels) -> int:
        """The node that the labels lead to from the root, in level order, or -1; no label leads to -1."""
        zeros, at = np.flatnonzero(~self.bits), 0
        for label in labels:
            lo = zeros[at - 1] + 1 - at if at else 0
            hi = zeros[at] - at
            i = lo + int(np.searchsorted(self.labels[lo:hi], label))
            if i >= hi or self.labels[i] != label:
                return -1
            at = i + 1
        return at - 1

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """The sum of values over each node's subtree; values are in level order, as is what is returned."""
        total, up, n = np.concatenate(([0], values)), self.parents(), self.children()
        lo, hi, levels = 0, int(n[0]), []
        while lo < hi:
            levels.append((lo, hi))
            lo, hi = hi, hi + int(n[lo + 1 : hi + 1].sum())
        for lo, hi in reversed(levels):
            np.add.at(total, up[lo:hi], total[lo + 1 : hi + 1])
        return total[1:]


def _rolled_up(batches):
    """A task's nodes, whole shards of them, with n_leaves and saved_tokens summed over subtrees, and which have no parent
    there."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    held = pa.Table.from_batches(batches).combine_chunks()
    of = {c: held.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("depth", "x", "y", "px", "py", "n_leaves", "saved_tokens")}
    n = held.num_rows
    both = np.stack([np.concatenate(p) for p in ((of["depth"], of["depth"] - 1), (of["x"], of["px"]), (of["y"], of["py"]))], 1)
    ids = np.unique(both, axis=0, return_inverse=True)[1].reshape(-1)
    at = np.full(ids.max() + 1, -1)
    at[ids[:n]] = np.arange(n)
    parent = at[ids[n:]]
    trie = Louds(parent, of["depth"], (of["x"] ^ of["px"]).view(np.uint64))
    for c in ("n_leaves", "saved_tokens"):
        total = np.empty(n, np.int64)
        total[trie.order] = trie.rollup(of[c][trie.order])
        held = held.set_column(held.schema.get_field_index(c), c, pa.array(total))
    yield from held.append_column("top", pa.array(parent < 0)).to_batches(max_chunksize=65_536)


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a and b (hashes of role and text) and bytes of each turn, in the order of turn (null first),
    role and text, counted within blocks of turn numbers and added up over them."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), block.alias("block"), "turn", role.alias("role"), text.alias("text"))
    own = lambda seed: F.xxhash64(F.lit(seed), F.col("role"), F.col("text"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(inside)).select("conv_id", "block", "nth", own(1).alias("a"), own(2).alias("b"), F.octet_length("text").cast("long").alias("bytes"))
    rows = cut(rows, "turns")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return rows.join(sizes, ["conv_id", "block"]).select("conv_id", (F.col("start") + F.col("nth")).alias("pos"), "a", "b", "bytes")


def rebuilt(rows: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Of positions(): the turns of the rebuilt conversations (conv_id, size, depth, a, b, bytes), and all of these
    (conv_id, size), turnless ones included. Conversation c takes the first crc32(c) % most turns of c - c % every."""
    branch = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", branch.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    first = rows.where((F.col("pos") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").where("pos <= h").select("conv_id", "size", F.col("pos").alias("depth"), "a", "b", "bytes")
    own = rows.join(convs, "conv_id").where("pos > h").select("conv_id", "size", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    return taken.union(own), convs.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, size, depth, x, y, px, py, bytes and upto of rebuilt() turns, written: the hashes of the prefix that ends with
    the turn and of the one before, and all bytes up to the turn."""
    block = F.floor(F.col("depth") / BLOCK).cast("long")
    rows = turns.select("conv_id", "size", "depth", "bytes", block.alias("block"), F.xxhash64("depth", "a").alias("a"), F.xxhash64("depth", "b").alias("b"))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(rows.withColumns({"x": F.bit_xor("a").over(upto), "y": F.bit_xor("b").over(upto), "upto": F.sum("bytes").over(upto)}), "prefixes")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.sum("bytes").alias("s"))
    sums = sums.select("conv_id", "block", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("by"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("bs"))
    x, y = F.col("x").bitwiseXOR(F.col("bx")), F.col("y").bitwiseXOR(F.col("by"))
    out = rows.join(sums, ["conv_id", "block"]).select("conv_id", "size", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("a")).alias("px"), y.bitwiseXOR(F.col("b")).alias("py"), "bytes", (F.col("upto") + F.col("bs")).alias("upto"))
    return cut(out, "prefixes")


def _ends(whole: DataFrame) -> DataFrame:
    """depth, x, y and ends_sha256 of the prefixes that are whole conversations. Members are joined in lists of near
    numbers; a prefix's lists, in order, run through one hash, so that no task holds all members."""
    lists = whole.groupBy("size", "x", "y", F.shiftright("conv_id", MEMBERS).alias("list")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    lists = lists.repartition("size", "x", "y").sortWithinPartitions("size", "x", "y", "list")

    def task(batches):
        now, state = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            done = []
            for key, ids in zip(keys, batch.column(4).to_pylist()):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["depth", "x", "y", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=["depth", "x", "y", "ends_sha256"])

    return lists.select(F.col("size").cast("long"), "x", "y", "list", "ids").mapInArrow(task, "depth long, x long, y long, ends_sha256 string")


def _shared(shared: DataFrame, paths: DataFrame, limit: int, most_upper: int) -> DataFrame:
    """The nodes of several conversations with n_leaves and saved_tokens over their subtrees. paths: conv_id, depth, x, y of
    the conversations that stand for equal ones."""
    while True:  # the root is an upper node always
        upper = shared.where((F.col("below") > limit) | (F.col("depth") == 0))
        if upper.count() <= most_upper:
            break
        limit *= 4
    keys = F.broadcast(upper.select("depth", "x", "y"))
    tops = paths.join(keys, ["depth", "x", "y"], "left_anti").groupBy("conv_id").agg(F.min_by(F.struct("x", "y"), "depth").alias("shard"))
    own = [*shared.columns]
    light = shared.where((F.col("below") <= limit) & (F.col("depth") > 0)).join(tops, "conv_id").select(*own, "shard")
    made = ", ".join(f"{c} {t}" for c, t in shared.dtypes) + ", top boolean"
    lower = cut(light.repartition("shard").select(*own).mapInArrow(_rolled_up, made), "shards")
    hung = lower.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    upper = upper.join(hung, ["depth", "x", "y"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))})
    upper = upper.select(*own).coalesce(1).mapInArrow(_rolled_up, made)
    return lower.select(*own).union(upper.select(*own))


def nodes(turns: DataFrame, every: int = 5, most: int = 9, most_upper: int = MOST_UPPER) -> DataFrame:
    """A row for each prefix of the rebuilt conversations, the empty one included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns need conv_id, turn, role and text; other columns are not read. A null role or text is empty; turns of an equal
    number are ordered by role and text, repeated rows are turns each, null numbers come first. Rows without a conv_id are no
    conversation's. Remainders of negative conv_ids are truncated, as in SQL. No conversations: no rows. Prefixes are
    compared by 128 bits of hashes. All turns of a conversation whose numbers are equal or null are ordered in one task.
    """
    spark = ready(turns.sparkSession)
    made, convs = rebuilt(cut(positions(turns), "turns"), every, most)
    rows = prefixes(made)
    whole = rows.where("depth = size").select("conv_id", "size", "x", "y", F.col("upto").alias("total")).union(convs.where("size = 0").select("conv_id", "size", *(F.lit(0).cast("long") for _ in range(3))))
    whole = cut(whole, "whole")
    alone = cut(whole.groupBy("size", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.min("total").alias("total")), "distinct")
    paths = rows.join(alone.select("conv_id", "copies", "total"), "conv_id")
    rest = F.col("total") - F.col("upto") + F.col("bytes")
    summed = (F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.count(F.lit(1)).alias("n_seqs"))
    every_node = paths.groupBy("depth", "x", "y").agg(*summed, F.sum(F.col("size") - F.col("depth")).alias("below"), F.max("size").alias("size"), F.min("bytes").alias("bytes"), F.min("px").alias("px"), F.min("py").alias("py"), F.min(rest).alias("rest"))
    zero = F.lit(0).cast("long")
    root = alone.agg(*summed, F.sum("size").alias("below"), F.max("size").alias("size"), F.min("total").alias("rest")).where("n_seqs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", "n_seqs", "below", "size", zero.alias("bytes"), zero.alias("px"), zero.alias("py"), "rest")
    every_node = cut(every_node.withColumn("depth", F.col("depth").cast("long")).union(root), "nodes")
    # What hangs from a node by tails of one conversation only.
    tail = F.col("n_seqs") == 1
    hung = every_node.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    hung = hung.agg(F.count(F.lit(1)).alias("n_children"), F.count_if(tail).alias("n_leaves"), F.sum(F.when(tail, (F.col("n_convs") - 1) * F.col("rest")).otherwise(0)).alias("tails"))
    shared = every_node.where("n_seqs > 1").join(hung, ["depth", "x", "y"])
    shared = cut(shared.select("conv_id", "depth", "x", "y", "px", "py", "n_convs", "n_children", "n_leaves", ((F.col("n_convs") - 1) * F.col("bytes") + F.col("tails")).alias("saved_tokens"), "below"), "shared")
    total = every_node.count()
    limit = max(LEAST, (shared.agg(F.max("below").alias("m")).first()["m"] or 0) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ["conv_id", "depth", "x", "y", "px", "py", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = _shared(shared, paths.select("conv_id", "depth", "x", "y"), limit, most_upper).select(*columns)
    tails = every_node.where(tail).select("conv_id", "depth", "x", "y", "px", "py", "n_convs", (F.col("depth") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"))
    found = inner.union(tails).join(_ends(whole), ["depth", "x", "y"], "left")
    found = cut(found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "found")
    # A parent that isn't shared is of the same conversation. Parents of many children, 4096 at most, are broadcast.
    many = max(LEAST, total // 4096)
    above = shared.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"), "n_children").withColumnRenamed("n_children", "siblings")
    here = found.join(F.broadcast(above.where(F.col("siblings") > many).drop("siblings")), ["depth", "px", "py"], "left")
    few = here.where("parent is null").drop("parent").join(above.where(F.col("siblings") <= many).drop("siblings"), ["depth", "px", "py"], "left")
    both = here.where("parent is not null").unionByName(few)
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    return both.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
