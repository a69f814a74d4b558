"""Passages of a benchmark in documents: a broadcast set of hashed windows of the items' words, scanned for in the documents'
words, every hit verified word by word; what is hit can be cut out, or documents of which too much is hit dropped.

Words are runs of ASCII letters (A-Z lower-cased), digits and anything beyond ASCII. A window is ten words in a row; an item
of fewer words is one window. A benchmark is broadcast in blocks of a checked size: up to `most_words` words and
`most_bytes` bytes it is one block and one scan; a larger one takes a scan for each block, whose runs of hit words are united.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, mixed, new_path, packed, ready

LENGTH = 10
#: A benchmark's words and bytes in one broadcast.
MOST_WORDS, MOST_BYTES = 4_000_000, 64 << 20
#: Bytes of text whose words are hashed at once; words longer than LONG are hashed by themselves.
BLOCK, LONG, SLICE = 1 << 20, 4096, 4 << 20
_TO = np.full(256, 32, np.uint8)
for _lo, _hi, _by in ((48, 58, 0), (97, 123, 0), (128, 256, 0), (65, 91, 32)):
    _TO[_lo:_hi] = np.arange(_lo, _hi) + _by
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
RUNS = "array<struct<first:int,end:int,start:int,stop:int>>"


class Words(NamedTuple):
    """raw: the texts' bytes, lower-cased; word i is raw[begin[i] : stop[i]]; text t's words are first[t] to first[t + 1];
    text t's bytes start at ends[t]."""

    raw: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    ends: np.ndarray


def words_in(texts: pa.Array) -> Words:
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), ""), pa.array([], pa.large_string())])
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1).copy() if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = _TO[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends -= ends[0]
    full = raw != 32
    apart = np.zeros(len(raw) + 1, bool)  # where a text starts
    apart[ends] = True
    begin, stop = full.copy(), full.copy()
    begin[1:] &= ~full[:-1] | apart[1:-1]
    stop[:-1] &= ~full[1:] | apart[1:-1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(raw, begin, stop, np.searchsorted(begin, ends), ends)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


_UP, _DOWN = _powers(_BASE, BLOCK + LONG + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + LONG + 1)


def hashed(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, in blocks of bytes: differences of running sums over bytes times powers of a base."""
    import xxhash

    out = np.zeros(len(w.begin), np.uint64)
    far = w.stop - w.begin > LONG
    near = np.flatnonzero(~far)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(near):
            lo = w.begin[near[at]]
            upto = max(at + 1, int(np.searchsorted(w.stop[near], lo + BLOCK, "right")))
            own = near[at:upto]
            hi = w.stop[own[-1]]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((w.raw[lo:hi].astype(np.uint64) + np.uint64(1)) * _UP[: hi - lo], out=sums[1:])
            out[own] = (sums[w.stop[own] - lo] - sums[w.begin[own] - lo]) * _DOWN[w.begin[own] - lo]
            at = upto
    for i in np.flatnonzero(far).tolist():
        out[i] = xxhash.xxh3_64_intdigest(w.raw[w.begin[i] : w.stop[i]].tobytes())
    return mixed(out)


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of the window of that many words from each word on, whatever text they are in."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, length):
            out *= _STEP
            out += h[j : j + n]
    return out


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _same(a: Words, p: np.ndarray, b: Words, q: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` words of a from p on are those of b from q on, for each pair (p, q)."""
    same = np.zeros(len(p), bool)
    step = max(1, (1 << 18) // length)
    for lo in range(0, len(p), step):
        i, j = (x[lo : lo + step, None] + np.arange(length) for x in (p, q))
        size = a.stop[i] - a.begin[i]
        ok = np.flatnonzero((size == b.stop[j] - b.begin[j]).all(1))
        if len(ok):
            size = size[ok].ravel()
            equal = _gathered(a.raw, a.begin[i[ok]].ravel(), size) == _gathered(b.raw, b.begin[j[ok]].ravel(), size)
            starts = np.concatenate(([0], np.cumsum(size.reshape(-1, length).sum(1))[:-1]))
            same[lo + ok] = np.logical_and.reduceat(equal, starts)
    return same


class Index:
    """The windows of some items: sorted hashes, where one of each begins in the items' words, and the items that have it."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids, self.words, self.of = ids, words_in(texts), {}
        h, count = hashed(self.words), np.diff(self.words.first)
        item = np.repeat(np.arange(len(ids)), count)
        for length in np.unique(np.minimum(count[count > 0], LENGTH)).tolist():
            own = np.flatnonzero((np.minimum(count, LENGTH) == length)[item] & (np.arange(len(h)) + length <= self.words.first[1:][item]))
            key = windows(h, length)[own]
            keys, first, at = np.unique(key, return_index=True, return_inverse=True)
            if not _same(self.words, own, self.words, own[first][at], length).all():
                raise RuntimeError("two windows of the benchmark have the same hash")
            pairs = np.unique(np.stack((at, item[own]), 1), axis=0)
            bits = max(16, int(len(keys) * 8).bit_length())
            maybe = np.zeros(1 << bits, bool)
            maybe[keys >> np.uint64(64 - bits)] = True
            self.of[length] = keys, own[first], np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1)), pairs[:, 1], maybe, bits

    def scan(self, texts: pa.Array):
        """For texts: their number of words, runs of hit words as (text, first, end, start, stop), and (text, item) pairs."""
        w = words_in(texts)
        h, count = hashed(w), np.diff(w.first)
        text = np.repeat(np.arange(len(count)), count)
        step, pairs = np.zeros(len(h) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        for length, (keys, begin, first, items, maybe, bits) in self.of.items():
            key = windows(h, length)
            p = np.flatnonzero(maybe[key >> np.uint64(64 - bits)])
            at = np.minimum(np.searchsorted(keys, key[p]), len(keys) - 1)
            ok = (keys[at] == key[p]) & (p + length <= w.first[1:][text[p]])
            p, at = p[ok], at[ok]
            ok = _same(w, p, self.words, begin[at], length)
            p, at = p[ok], at[ok]
            np.add.at(step, p, 1)
            np.add.at(step, p + length, -1)
            found = np.unique(text[p] * len(keys) + at)
            t, at = found // len(keys), found % len(keys)
            size = first[at + 1] - first[at]
            pairs.append(np.unique(np.stack((np.repeat(t, size), _gathered(items, first[at], size)), 1), axis=0))
        hit = np.cumsum(step)[:-1] > 0
        a, b = hit.copy(), hit.copy()  # first and last words of runs; a run ends with its text
        same = text[1:] == text[:-1]
        a[1:] &= ~(hit[:-1] & same)
        b[:-1] &= ~(hit[1:] & same)
        a, b = np.flatnonzero(a), np.flatnonzero(b)
        t = text[a]
        return count, (t, a - w.first[t], b + 1 - w.first[t], w.begin[a] - w.ends[t], w.stop[b] - w.ends[t]), np.unique(np.concatenate(pairs), axis=0)


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """values as a list for each of n rows; of: each value's row, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _slices(batch: pa.RecordBatch, column: int):
    """The batch in parts of some SLICE bytes of text, or of one row."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0)).astype(np.int64)) if len(batch) else np.zeros(0)
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _scanned(batches, index):
    ids = pa.array(index.value.ids, pa.string())
    for whole in batches:
        for batch in _slices(whole, 1):
            n = len(batch)
            count, (t, *run), pairs = index.value.scan(batch.column(1))
            runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in run], names=["first", "end", "start", "stop"])
            pairs = pairs[np.asarray(ids.is_valid())[pairs[:, 1]]] if len(pairs) else pairs
            names = pa.array(ids.take(pa.array(pairs[:, 1])).to_pylist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count.astype(np.int64)), _lists(t, n, runs), _lists(pairs[:, 0], n, names)], names=["row", "n_words", "runs", "items"])


def _blocks(bench: DataFrame, item: str, text: str, most_words: int, most_bytes: int) -> list[tuple[list, pa.Array]]:
    """The benchmark's items in blocks of a checked size, one after the other; nothing but one block is on the driver."""
    items = bench.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("length(text) > 0")
    items = items.withColumn("words", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).where("words > 0")
    total = items.agg(F.sum("words").alias("w"), F.sum(F.octet_length("text")).alias("b")).first()
    k = max(1, -(-(total["w"] or 0) // most_words), -(-(total["b"] or 0) // most_bytes))
    if k > 1:  # shares differ a little
        k = 2 * k
    for i in range(k):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(k)) == i).select("id", "text") if k > 1 else items.select("id", "text")
        held = own.toArrow()
        if held.num_rows or not i:
            yield held.column("id").to_pylist(), pa.concat_arrays([*(c.cast(pa.large_string()) for c in held.column("text").chunks), pa.array([], pa.large_string())])


def find(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each of docs: row (all its columns but the text, as one struct), the text, n_words, n_hit, runs (of hit
    words: their numbers from 0 and their bytes in the text) and items (distinct item_ids as strings, sorted, whose windows
    occur).

    docs need a column text, bench has item_id and text; other columns of docs come back whatever their names, others of
    bench are not read. A null or empty text has no words and is hit by nothing. Items without words have no window; items
    without an id hit words but are not in items. Rows of an equal item_id are one item with the windows of all of them.
    Repeated documents are rows each. An empty benchmark hits nothing; no documents: no rows. One item must fit in a block.
    """
    spark = ready(docs.sparkSession)
    own, made = docs.select(packed(docs, "own", (text,)), F.col(f"`{text}`").alias("text")), f"n_words long, runs {RUNS}, items array<string>"
    blocks = _blocks(bench, item, text, most_words, most_bytes)
    now, following = next(blocks), next(blocks, None)
    if following is None:
        index = spark.sparkContext.broadcast(Index(*now))
        both = own.select(F.struct("own", "text").alias("row"), "text")
        found = both.mapInArrow(lambda it: _scanned(it, index), f"row {both.schema['row'].dataType.simpleString()}, {made}")
        return _counted(found.select("row.own", "row.text", "n_words", "runs", "items"))
    # A row's number holds over the scans, for it is written.
    held, parts = cut(own.withColumn("at", F.monotonically_increasing_id()), "documents"), new_path(spark, "found")
    while now is not None:
        index = spark.sparkContext.broadcast(Index(*now))
        part = held.select("at", "text").mapInArrow(lambda it, index=index: _scanned(it, index), f"row long, {made}")
        part.write.mode("append").parquet(parts)
        index.unpersist()
        now, following = following, next(blocks, None)
    joined = spark.read.parquet(parts).groupBy(F.col("row").alias("at")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = joined.withColumn("runs", F.expr(f"""aggregate(runs, cast(array() as {RUNS}), (a, r) -> case when size(a) > 0 and a[size(a) - 1].end >= r.first
        then concat(slice(a, 1, size(a) - 1), array(named_struct('first', a[size(a) - 1].first, 'end', greatest(a[size(a) - 1].end, r.end), 'start', a[size(a) - 1].start, 'stop', greatest(a[size(a) - 1].stop, r.stop))))
        else concat(a, array(r)) end)"""))
    return _counted(held.join(joined, "at").select("own", "text", "n_words", "runs", "items"))


def _counted(found: DataFrame) -> DataFrame:
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"])
    return found.select("own", "text", "n_words", hit.alias("n_hit"), "runs", F.array_sort("items").alias("items"))


def without(text: Column, runs: Column) -> Column:
    """The text without the bytes of the runs; what stands between words around them stays."""
    raw = F.to_binary(text, F.lit("utf-8"))
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"]))
    stops = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.octet_length(text)))
    kept = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(raw, p["a"] + 1, p["b"] - p["a"]).cast("string"))
    return F.when(F.size(runs) == 0, text).otherwise(F.array_join(kept, ""))


def clean(docs: DataFrame, bench: DataFrame, most_share: float = 0.5, text: str = "text", item: str = "item_id") -> DataFrame:
    """docs without the words that benchmark items hit, and without the documents of which a larger share is hit than
    most_share (0: any hit document goes; 1: none). Columns are those of docs; a null text stays null. As find() otherwise."""
    found = find(docs, bench, text, item).where(F.col("n_hit") <= F.lit(float(most_share)) * F.col("n_words"))
    return found.select(*((without(F.col("text"), F.col("runs")) if c == text else F.col("own").getField(c)).alias(c) for c in docs.columns))


def digests(docs: DataFrame, bench: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, as find() has them; items_sha256 is
    of the sorted item_ids, comma-joined, and of the empty string where there are none."""
    found = find(docs.select("doc_id", "text"), bench, most_words=most_words)
    return found.select("own.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
