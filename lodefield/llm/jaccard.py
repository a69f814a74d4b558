"""Parity-sketch join: all pairs of token sets of a Jaccard similarity of `percent` or more, exactly, and their components.

Sets a and b with 100 |a & b| >= P |a | b| differ in at most d = (100 - P) (|a| + |b|) / (100 + P) tokens. Three things
are made of the xor of token hashes:

    keys      For each band of sizes the token space is dealt into more than d parts; a part's key is the xor of the
              hashes of a set's tokens there. Parts without a differing token have equal keys, so two similar sets share
              all but d of their keys (pigeonhole). Of these each set puts out its first d + 1 in an order that all sets
              have in common, parts of many tokens first: two similar sets still share one (prefix filter), and parts
              that hold a single token of some common passage are hardly ever among them.
    sketches  The parity of the tokens in each of 8 or more bits a token. The Hamming distance of two sketches is never
              more than the sets' difference: pairs beyond d are dropped without looking at the sets.
    sets      Pairs that are left are verified on the sets themselves (64-bit hashes of the shingles).

Sets are joined only if that can join components. First each set meets the first set of each of its keys' groups: the
nearest of them, then the nearest pairs between the components that this makes. Then groups that still hold more than one
component are searched for pairs between components, in blocks of bounded size: for each component but a group's largest
the few nearest pairs not tried yet, more of them round by round, until none is left. Sets of equal tokens are one set
from the start; a set is known by 64 bits of its tokens, and found again by the hash of one of its texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, cut, drop, mixed, ready, word_hashes, words_of

#: Sets of a group in a block; pairs that a component is given in a group at first, and by how much they grow.
BLOCK, FIRST, GROWTH = 4096, 4, 4


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80


def sets_of(texts: pa.Array, words: int):
    """The texts' sets, each the sorted distinct hashes of its shingles."""
    flat, ends = words_of(texts)
    own = word_hashes(flat)
    with np.errstate(over="ignore"):
        rolled = own.copy() if len(own) else np.zeros(0, np.uint64)
        for i in range(1, words):
            ahead = np.zeros_like(own)
            ahead[:-i] = own[i:]
            rolled = mixed(rolled) * np.uint64(0x9E3779B97F4A7C15) + ahead
        rolled = mixed(rolled)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:  # the whole sequence as one
                x = np.uint64(b - a)
                for h in own[a:b]:
                    x = mixed(np.array([x]))[0] * np.uint64(0x9E3779B97F4A7C15) + h
                yield mixed(np.array([x]))
            else:
                yield np.zeros(0, np.uint64)


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits that tell each of the sets apart: made of the sum and the xor of its tokens' hashes and of its size."""
    size = np.array([len(x) for x in sets], np.int64)
    out, full = np.zeros(len(sets), np.uint64), np.flatnonzero(size)
    if len(full):
        flat = np.concatenate(sets)
        first = (np.cumsum(size) - size)[full]
        with np.errstate(over="ignore"):
            a = np.add.reduceat(mixed(flat ^ np.uint64(0xA24BAED4963EE407)), first)
            b = np.bitwise_xor.reduceat(mixed(flat ^ np.uint64(0x9FB21C651E98DF25)), first)
            out[full] = mixed(a + mixed(b + size[full].astype(np.uint64)))
    return out.view(np.int64)


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each bit; 8 to 16 bits a token, a power of 2, in words of 64 bits."""
    bits = 1 << max(6, int(8 * len(tokens) - 1).bit_length())
    at = (mixed(tokens ^ np.uint64(0xE7037ED1A0B428DB)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def keys_of(tokens: np.ndarray, join: Join) -> np.ndarray:
    """The set's keys, for the band of its size and, if it can be the larger set there, for the band below."""
    n, p = len(tokens), join.percent
    out = []
    for band in (n.bit_length() - 1, n.bit_length() - 2):
        smallest, largest = 1 << band if band >= 0 else 0, (2 << band) - 1 if band >= 0 else 0  # of the smaller sets
        if band < 0 or n > 100 * largest // p:
            continue
        # How far a set of this size can be from a similar one of the band; no similar set is larger than 100 n / p.
        partner = 100 * n // p if n <= largest else largest
        d = (100 - p) * (n + partner) // (100 + p)
        most = (100 - p) * (largest + 100 * largest // p) // (100 + p)
        parts = max(most + 1, int(1.3 * (most + 1)))
        own = mixed(tokens + np.uint64(band + 1))
        part = (own % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at, first, count = np.unique(part[order], return_index=True, return_counts=True)
        size, xor = np.zeros(parts, np.int64), np.zeros(parts, np.uint64)
        size[at], xor[at] = count, np.bitwise_xor.reduceat(mixed(own[order]), first)
        with np.errstate(over="ignore"):
            key = mixed(xor + mixed(np.arange(parts, dtype=np.uint64) * np.uint64(64) + np.uint64(band)) + size.astype(np.uint64))
        out.append(key[np.lexsort((key, -size))[: d + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of sketches, rows of a with rows of b; a power of 2 more words on one side are folded."""
    while a.shape[-1] > b.shape[-1]:
        a = a[..., : a.shape[-1] // 2] ^ a[..., a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[..., : b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2 :]
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _slices(batches, rows: int = 512):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, the hash t of the text, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))


def classes(docs: DataFrame, join: Join = Join(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n, id) of every document, id naming its set of n tokens and t the text's hash, and (id, root) of
    the sets that links join: root is the smallest id of the component."""
    ready(docs.sparkSession)
    docs = _keyed(docs, text)

    def light(batches):
        for part in _slices(batches):
            sets = list(sets_of(part.column(2), join.words))
            names, seen, s = names_of(sets), set(), []
            for x, f in zip(sets, names.tolist()):
                s.append(None if f in seen or not len(x) else sketch_of(x).tobytes())  # copies need no more than one
                seen.add(f)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(names), pa.array(s, pa.binary())], names=["doc_id", "t", "n", "id", "sketch"])

    whole = cut(docs.mapInArrow(light, "doc_id long, t long, n long, id long, sketch binary"), "sets")
    sets = cut(whole.where("sketch is not null").select("id", "n", "t", "sketch").dropDuplicates(["id"]), "classes")
    rows = cut(whole.drop("sketch"), "sets")
    drop(whole)

    def keyed(batches):
        seen: set = set()
        for part in _slices(batches):
            sets = list(sets_of(part.column(2), join.words))
            keys, names = [], []
            if len(seen) > 1 << 14:  # only saves shuffling
                seen.clear()
            for x, f in zip(sets, names_of(sets).tolist()):
                if len(x) and f not in seen:
                    seen.add(f)
                    keys.append(keys_of(x, join).view(np.int64))
                    names.append(np.full(len(keys[-1]), f))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names))], names=["key", "id"])

    keys = docs.mapInArrow(keyed, "key long, id long").repartition("key").sortWithinPartitions("key", "id")
    groups = cut(keys.mapInArrow(_grouped, "key long, id long, seq long"), "groups")
    # Near copies share many keys: of groups of the same sets, told apart by 128 bits and their size, one is enough.
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"mark{i}") for i in (1, 2)]
    once = groups.groupBy("key").agg(*marks, F.count(F.lit(1)).alias("size")).groupBy("mark1", "mark2", "size").agg(F.min("key").alias("key")).select("key")
    members = cut(groups.join(once, "key", "left_semi"), "members")
    drop(groups)

    # First each set with the first one of its groups.
    firsts = members.where("seq = 0").select("key", F.col("id").alias("a"))
    stars = members.where("seq > 0").join(firsts, "key").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    near = cut(_sketched(stars, sets, join), "stars")
    best = near.groupBy("b").agg(F.min_by("a", F.struct("gap", "a")).alias("a")).select("a", "b")
    tried = [verified(docs, sets, best, join)]
    # Stars around several first sets of one group of near copies are tied together by the nearest pairs between them.
    roots = connected(tried[0].where("linked").select("a", "b"))
    tried.append(verified(docs, sets, _ties(near, tried[0], roots), join))
    drop(near)
    found, width = [], FIRST
    drop(roots)
    while True:
        done = _all(tried)
        roots = connected(done.where("linked").select("a", "b"))
        bounds = _all(found).groupBy("key", "id", "tb").agg(F.max(F.struct("gap", "other")).alias("upto")) if found else None
        found.append(cut(_between(members, sets, roots, bounds, join, width), "pairs"))
        if found[-1].isEmpty():
            break
        pairs = found[-1].select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        tried.append(verified(docs, sets, pairs.join(done, ["a", "b"], "left_anti"), join))
        drop(roots)
        again = found[-1].where("more").select("key").distinct()
        if again.isEmpty():  # all candidates of all groups were tried
            roots = connected(_all(tried).where("linked").select("a", "b"))
            break
        # Sketches do not change and components only grow: a group whose candidates were all tried never has any again.
        left = cut(members.join(again, "key", "left_semi"), "members")
        drop(members)
        members, width = left, width * GROWTH
    drop(members, sets, *found, *tried)
    return rows, roots


def components(docs: DataFrame, join: Join = Join(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every row.

    Needs doc_id and the text column; other columns are not read. Texts that are null or have no word have no set and
    link with nothing: they are their own component. Repeated doc_ids are rows each, whatever their texts. Rows without
    a doc_id carry links as others do; component_id is null where no reachable row has a doc_id. No rows: no rows.
    """
    rows, roots = classes(docs, join, text)
    least = rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    tops = least.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(least.join(tops, "root").select("id", "component_id"), "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(batches):
    """Of rows in the order of key and id, the groups of two sets or more: key, id, the set's number in its group."""
    last_key, last_id, seq, held = None, None, 0, False
    for batch in batches:
        key, of = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        new[0] = key[0] != last_key or of[0] != last_id
        key, of = key[new], of[new]
        if not len(key):
            continue
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        carried = key[0] == last_key
        start[0] = not carried
        first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
        number = np.arange(len(key)) - first
        if carried:
            same = first == 0
            number[same & (key == key[0])] += seq + 1
        inside = number > 0  # a group's first set counts if a second follows; the last row's may follow later
        inside[:-1] |= ~start[1:]
        out_key, out_id, out_n = key[inside], of[inside], number[inside]
        if carried and held:  # the first set of the group that goes on, left behind by the batch before
            out_key, out_id, out_n = np.append(out_key, last_key), np.append(out_id, last_id), np.append(out_n, 0)
        yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_id), pa.array(out_n)], names=["key", "id", "seq"])
        last_key, last_id, seq = key[-1], of[-1], int(number[-1])
        held = seq == 0


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _sketched(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Of pairs (a, b) those that sizes and sketches leave, with gap: their distance for each token."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

    def run(batches):
        for batch in batches:
            na, nb = np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))
            d = np.array([distances(x, y) for x, y in zip(_unpack(batch.column("s_a")), _unpack(batch.column("s_b")))], np.int64)
            ok = ((100 + join.percent) * d <= (100 - join.percent) * (na + nb)) & (100 * np.minimum(na, nb) >= join.percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d / (na + nb))], names=["a", "b", "gap"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long, gap double")


def _ties(near: DataFrame, tried: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the pairs near (a, b, gap) that lie in two components and are not tried yet, for any two components the four
    nearest or fewer: the nearest in each quarter of the ids b, so that none but partial minima are shuffled."""
    top = lambda k: roots.select(F.col("id").alias(k), F.col("root").alias(f"top_{k}"))
    own = near.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(top("a"), "a", "left").join(top("b"), "b", "left")
    x, y = F.coalesce("top_a", "a"), F.coalesce("top_b", "b")
    own = own.where(x != y).groupBy(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), F.pmod("b", F.lit(4)).alias("part"))
    return own.agg(F.min_by(F.struct("a", "b"), F.struct("gap", "a", "b")).alias("pair")).select("pair.a", "pair.b")


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """(a, b, linked) of pairs of sets, by all their tokens, written. Up to a million hashes of texts are broadcast to find
    a text of each set."""
    pairs = cut(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = ids.join(sets.select("id", F.col("t").alias("of")), "id").select("of").distinct()
    side = F.broadcast(texts) if pairs.limit(500_001).count() <= 500_000 else texts

    def run(batches):
        seen: set = set()
        for part in _slices(batches):
            own = list(sets_of(part.column(0), join.words))
            names, once = names_of(own), []
            if len(seen) > 1 << 14:  # only saves shuffling copies
                seen.clear()
            for i, f in enumerate(names.tolist()):
                if f not in seen:
                    seen.add(f)
                    once.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(names[once]), pa.array([own[i].tobytes() for i in once], pa.binary())], names=["id", "tokens"])

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(_unpack(batch.column("t_a")), _unpack(batch.column("t_b"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= join.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    found = docs.join(side, docs["t"] == side["of"], "left_semi").select("text").mapInArrow(run, "id long, tokens binary")
    tokens = cut(found.groupBy("id").agg(F.first("tokens").alias("tokens")), "tokens")
    own = lambda k: tokens.select(F.col("id").alias(k), F.col("tokens").alias(f"t_{k}"))
    out = cut(pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(compare, "a long, b long, linked boolean"), "tried")
    drop(tokens, pairs)
    return out


def _between(members: DataFrame, sets: DataFrame, roots: DataFrame, bounds: DataFrame | None, join: Join, width: int) -> DataFrame:
    """Pairs (id, other) of sets of a key's group that lie in two components, as far as sketches leave them: for each
    component but the group's largest, and each block, the `width` nearest that are not tried yet, with whether there are
    more. bounds: up to which (gap, other) each set's candidates of a block were tried."""
    own = members.join(roots.withColumnRenamed("root", "top"), "id", "left").select("key", "id", "seq", F.coalesce("top", "id").alias("top"))
    tops = own.groupBy("key", "top").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    open_ = tops.groupBy("key").agg(F.max_by("top", F.struct("n", "top")).alias("main"), F.count(F.lit(1)).alias("tops"), blocks(F.max("last") + 1).alias("tbs"), blocks(F.sum("n") - F.max("n")).alias("sbs")).where("tops > 1")
    own = own.join(open_, "key")
    # Every set can be found, in its block; those outside the largest component seek, each in all blocks.
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = own.select("key", "id", "top", F.lit(False).alias("seeks"), F.floor(F.col("seq") / BLOCK).cast("int").alias("tb"), upto("sbs").alias("sb"))
    seek = own.where("top <> main").select("key", "id", "top", F.lit(True).alias("seeks"), upto("tbs").alias("tb"), F.pmod(F.xxhash64("id"), F.col("sbs")).cast("int").alias("sb"))
    both = there.union(seek)
    if bounds is None:
        both = both.withColumn("upto", F.lit(None).cast("struct<gap double, other long>"))
    else:
        both = both.join(bounds, ["key", "id", "tb"], "left")
    both = both.join(sets.select("id", "n", "sketch"), "id").select("key", "tb", "sb", "id", "top", "seeks", "n", "sketch", F.col("upto.gap").alias("gap"), F.col("upto.other").alias("other"))
    both = both.repartition("key", "tb", "sb").sortWithinPartitions("key", "tb", "sb")

    def run(batches):
        group, name = [], None
        for batch in batches:
            for row in batch.to_pylist():
                at = row["key"], row["tb"], row["sb"]
                if at != name:
                    if group:
                        yield from _cross(group, join, width)
                    group, name = [], at
                group.append(row)
        if group:
            yield from _cross(group, join, width)

    return both.mapInArrow(run, "key long, id long, other long, tb int, gap double, more boolean")


def _cross(group: list[dict], join: Join, width: int):
    """The pairs of one block of a group's sets and some that seek, as _between() asks for them."""
    there, seek = [r for r in group if not r["seeks"]], [r for r in group if r["seeks"]]
    if not there or not seek:
        return
    ids, n, tops = (np.array([r[k] for r in there]) for k in ("id", "n", "top"))
    sketches: dict[int, list] = {}
    for k, r in enumerate(there):
        sketches.setdefault(len(r["sketch"]) // 8, []).append(k)
    blocks = [(np.array(at), np.stack([np.frombuffer(there[k]["sketch"], np.uint64) for k in at])) for at in sketches.values()]
    found: dict[int, list] = {}
    for r in seek:
        mine = np.frombuffer(r["sketch"], np.uint64)
        for at, s in blocks:
            ok = (tops[at] != r["top"]) & (100 * np.minimum(n[at], r["n"]) >= join.percent * np.maximum(n[at], r["n"]))
            at, s = at[ok], s[ok]
            d = distances(s, mine)
            ok = (100 + join.percent) * d <= (100 - join.percent) * (n[at] + r["n"])
            at, gap = at[ok], d[ok] / (n[at[ok]] + r["n"])
            if r["gap"] is not None:
                ok = (gap > r["gap"]) | ((gap == r["gap"]) & (ids[at] > r["other"]))
                at, gap = at[ok], gap[ok]
            if len(at) > width:  # no more of one set can be among its component's
                order = np.lexsort((ids[at], gap))[: width + 1]
                at, gap = at[order], gap[order]
            if len(at):
                found.setdefault(r["top"], []).append((np.full(len(at), r["id"]), ids[at], gap))
    out = []
    for parts in found.values():
        of, other, gap = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((of, other, gap))
        more = len(order) > width
        out.append((of[order[:width]], other[order[:width]], gap[order[:width]], np.full(min(width, len(order)), more)))
    if out:
        of, other, gap, more = (np.concatenate(x) for x in zip(*out))
        same = lambda v, kind: pa.array(np.full(len(of), v), kind)
        yield pa.RecordBatch.from_arrays([same(group[0]["key"], pa.int64()), pa.array(of), pa.array(other), same(group[0]["tb"], pa.int32()), pa.array(gap), pa.array(more)], names=["key", "id", "other", "tb", "gap", "more"])


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One document of each component, that of the smallest doc_id, in the columns that came in.

    Rows without a doc_id stay only where no row of their component has one; among rows of equal doc_id the one of the
    smallest hash of its text stays, and of rows equal in both any one. Texts without a word all stay. The texts
    themselves are not shuffled, but for those of repeated rows."""
    rows, roots = classes(docs, join)
    rows = rows.where("n > 0").join(roots, "id", "left").select("doc_id", "t", F.coalesce("root", "id").alias("root"))
    rows = rows.groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first"), F.count(F.lit(1)).alias("size"))
    joined = cut(rows.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))).where("not stays or n > 1"), "gone")
    few = lambda df: F.broadcast(df) if df.limit(1_000_001).count() <= 1_000_000 else df
    gone, again = joined.where("not stays"), joined.where("stays")
    same = lambda side: docs["doc_id"].cast("long").eqNullSafe(side["doc_id"]) & (F.xxhash64(docs["text"]) == side["t"])
    gone, again = (few(x.select("doc_id", "t")) for x in (gone, again))
    out = docs.join(gone, same(gone), "left_anti")
    if joined.where("stays").isEmpty():
        return out
    once = docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, same(again), "left_anti").unionByName(once)
