"""Scoring of texts by a bigram model whose counts lie in a log-frequency Bloom filter (Talbot and Osborne, 2007).

A count is stored as its level: a word's is 1 to 8, then there are four levels for each doubling; a pair's is 1 to 4, then
there are two. The n-gram is entered with each level up to
its own, and read back by probing level after level until one is missing. A level is never read too low, and too high with
a small probability.

The filter is made of blocks, an n-gram's hash tells its block, and each block is built by one task, with 12 bits for
each of its entries. All unigrams and all bigrams are in it: its size grows with the corpus. Up to most_mb it is
broadcast. A larger one stays where it is: each chunk of texts sends its distinct n-grams to their blocks and gets their
levels back, with the same scores.

Probabilities are interpolated: p(w | h) = (1 - m) p(w) + m c(h w) / c(h). p(w) = (c(w) + 0.1) / Z is made of the levels'
least counts, and Z is their sum over all words, so that it sums to 1 over the words and one class of unknown ones. The
share behind a history has the level's least count above and its largest below: it sums to 1 at most, and to no less than
a half, so that what p(w | h) leaves unassigned is a quarter at most (for m = 1/2; pairs seen once or twice, the most of
them, leave nothing), and nothing behind an unknown history.

Words are known by 64-bit hashes throughout. Beside the model's score each text gets its exact base score: counts of the
most frequent words are broadcast (as many as hot_words), the others are joined by word, of which none is frequent.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, mixed, ready, word_hashes, words_of

#: Stands for the end of a text, as a token; for its beginning, only as a history.
END, BEGIN = np.uint64(1), np.uint64(2)
PROBES, BITS_EACH, LEVELS = 4, 12, 208
#: Levels for each doubling of a unigram's and of a bigram's count.
UNI, BI = 4, 2
STRIDE = np.uint64(0xD1342543DE82EF95)
#: Words of a line of memory, and levels of a key that lie in one.
LINE, GROUP = 8, 8
#: Tokens learnt from for each block of the filter; documents and bytes of text in a chunk.
BLOCK_TOKENS, CHUNK_DOCS, CHUNK_BYTES = 1 << 19, 2048, 4 << 20


def learns(doc_ids: list) -> np.ndarray:
    """Whether a document is learnt from; the others are held out. A null doc_id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i in doc_ids], bool)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, each text followed by END, and each text's number of tokens."""
    flat, ends = words_of(texts)
    return np.insert(word_hashes(flat), ends[1:], END), np.diff(ends) + 1


def pairs_of(tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token's history and of history and token."""
    before = np.roll(tokens, 1)
    before[np.cumsum(size) - size] = BEGIN
    with np.errstate(over="ignore"):
        return before, mixed(mixed(before) * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _counted(docs: DataFrame, order: int, batch_of, schema: str) -> DataFrame:
    """batch_of(keys, n) of all unigrams (order 1; BEGIN is one) or bigrams (order 2) of the documents learnt from, by
    slices of batches."""

    def run(batches):
        for batch in batches:
            keep = learns(batch.column(0).to_pylist())
            for lo in range(0, batch.num_rows, 4096):
                own = keep[lo : lo + 4096]
                texts = batch.column(1).slice(lo, 4096).filter(pa.array(own))
                if not len(texts):
                    continue
                tokens, size = tokens_of(texts)
                yield batch_of(*_summed(np.append(tokens, np.full(len(size), BEGIN)) if order == 1 else pairs_of(tokens, size)[1]))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def count(docs: DataFrame, order: int) -> DataFrame:
    """(key, n) of all unigrams or bigrams of the documents learnt from."""
    rows = _counted(docs, order, lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"]), "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


class Filter:
    """Blocks of bits, in 64-bit words one after the other, block i from word starts[i] on."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts = words, starts

    def levels(self, keys: np.ndarray) -> np.ndarray:
        block = block_of(keys, len(self.starts) - 1)
        return levels_in(self.words, keys, self.starts[block], np.diff(self.starts)[block])


def levels_in(words: np.ndarray, keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys' levels, each read in its own block of `size` words from word `first` on. A block may be empty. Lines are
    fetched for a few thousand keys at a time, so that they are still at hand when their bits are looked at."""
    out, lines = np.zeros(len(keys), np.int64), words.reshape(-1, LINE)
    for lo in range(0, len(keys), 8192):
        at = lo + np.flatnonzero(size[lo : lo + 8192])
        for group in range(0, LEVELS, GROUP):
            if not len(at):
                break
            base = _base(keys[at], group)
            here = lines[first[at] // LINE + _scaled(base, size[at] // LINE).astype(np.int64)].reshape(-1)
            row = np.arange(len(at)) * LINE
            for level in range(max(1, group), group + GROUP):
                hit = np.ones(len(at), bool)
                for word, bit in _bits(base, level):
                    hit &= (here[row + word] >> bit) & np.uint64(1) == 1
                at, base, row = at[hit], base[hit], row[hit]
                out[at] = level
                if not len(at):
                    break
    return out


def level_of(n: np.ndarray, fine: int) -> np.ndarray:
    """The levels of counts: 1 to 2 * fine for such counts, then `fine` levels (a power of 2) for each doubling."""
    n, bits = n.astype(np.int64), fine.bit_length() - 1
    e = np.frexp(n.astype(np.float64))[1] - 1
    return np.where(n <= 2 * fine, n, 2 * fine + fine * (e - 1 - bits) + ((n >> np.maximum(e - bits, 0)) & (fine - 1)))


def lowest(level: np.ndarray, fine: int) -> np.ndarray:
    """The smallest count of a level; 0 of none."""
    k = np.maximum(level - 2 * fine, 0)
    return np.where(level <= 2 * fine, level, (fine + k % fine) << (1 + k // fine))


def highest(level: np.ndarray, fine: int) -> np.ndarray:
    """The largest count of a level; 0 of none."""
    return np.where(level > 0, lowest(level + 1, fine) - 1, 0)


def _scaled(hashes: np.ndarray, n) -> np.ndarray:
    """Hashes brought to 0 to n - 1, n below 2 ** 32, in their own order."""
    return ((hashes >> np.uint64(32)) * np.asarray(n).astype(np.uint64)) >> np.uint64(32)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks in the order of keys, so that sorted keys are looked up block by block. Keys are hashes."""
    return _scaled(keys, blocks).astype(np.int64)


def _base(keys: np.ndarray, group: int) -> np.ndarray:
    """What a key's line and bits for a group of levels are made of."""
    with np.errstate(over="ignore"):
        return mixed(keys + np.uint64(group) * STRIDE)


def _bits(base: np.ndarray, level: int):
    """For each probe, the word and bit of a key's level in the key's line."""
    with np.errstate(over="ignore"):
        a = mixed(base + np.uint64(level) * STRIDE)
    for i in range(PROBES):
        p = (a >> np.uint64(9 * i)) & np.uint64(64 * LINE - 1)
        yield (p >> np.uint64(6)).astype(np.int64), p & np.uint64(63)


def positions(keys: np.ndarray, level: int, size: int):
    """For each probe, the word and bit of every key's level in a block of `size` words: a key's levels, GROUP at a time, lie
    in one line of LINE words, which memory gives in one piece."""
    base = _base(keys, level // GROUP * GROUP)
    line = _scaled(base, size // LINE).astype(np.int64) * LINE
    for word, bit in _bits(base, level):
        yield line + word, bit


def _dealt(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts keys block by block, the blocks that have any, and where each starts (one more at the end)."""
    block = block_of(keys, blocks)
    order = np.argsort(block, kind="stable")
    own, first = np.unique(block[order], return_index=True)
    return order, own, np.append(first, len(keys))


def _packed(keys: np.ndarray, n: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One row for each block: its keys and their counts as bytes."""
    order, own, at = _dealt(keys, blocks)
    keys, n = keys[order], n[order].astype(np.int64)
    parts = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(own), parts(keys), parts(n)], names=["block", "keys", "n"])


PACKED = "block long, keys binary, n binary"


def packed(counted: DataFrame, blocks: int, sign: int = 1) -> DataFrame:
    """Rows (key, n), dealt to blocks. The counts of unigrams are negative there (sign -1), which tells their levels."""

    def run(batches):
        for batch in batches:
            yield _packed(np.asarray(batch.column("key")).view(np.uint64), sign * np.asarray(batch.column("n")), blocks)

    return counted.select("key", F.col("n").cast("long").alias("n")).mapInArrow(run, PACKED)


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def built(rows: DataFrame) -> DataFrame:
    """(block, bits) of the filter of all n-grams in packed rows, whose counts of equal keys add up."""

    def run(table: pa.Table) -> pa.Table:
        keys, of = np.unique(_joined(table.column("keys"), np.uint64), return_inverse=True)
        n = np.bincount(of, _joined(table.column("n"), np.int64), len(keys))
        level = np.minimum(np.where(n < 0, level_of(-n, UNI), level_of(n, BI)), LEVELS - 1)
        bits = np.zeros(LINE * -(-int(level.sum()) * BITS_EACH // (64 * LINE)), np.uint64)
        for j in range(1, int(level.max()) + 1):
            for word, bit in positions(keys[level >= j], j, len(bits)):
                np.bitwise_or.at(bits, word, np.uint64(1) << bit)
        return pa.table([pa.array([table.column("block")[0].as_py()]), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    return rows.groupBy("block").applyInArrow(run, "block long, bits binary")


def collected(bits: DataFrame, blocks: int) -> Filter:
    """The whole filter, for one that a broadcast holds."""
    own = {r["block"]: np.frombuffer(r["bits"], np.uint64) for r in bits.toLocalIterator()}
    parts = [own.get(i, np.zeros(0, np.uint64)) for i in range(blocks)]
    return Filter(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))


def build(uni: DataFrame, bi: DataFrame, blocks: int = 8) -> tuple[Filter, int]:
    """The filter of counts that lie in tables (key, n), and its size in bytes."""
    model = collected(built(packed(uni, blocks, -1).union(packed(bi, blocks))), blocks)
    return model, model.words.nbytes


def _chunks(docs: DataFrame) -> DataFrame:
    """(row, doc_ids, texts): rows in chunks, each named after its first row's number."""

    def run(batches):
        at, base = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                past = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK_BYTES, "right"))
                hi = min(max(past, lo + 1), lo + CHUNK_DOCS, batch.num_rows)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + at + lo]), *(pa.array([part.column(i).to_pylist()], pa.list_(t)) for i, t in ((0, pa.int64()), (1, pa.string())))], names=["row", "doc_ids", "texts"]
                )
                lo = hi
            at += batch.num_rows

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "row long, doc_ids array<long>, texts array<string>")


def _keys(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate((tokens, pairs_of(tokens, size)[1], [BEGIN])))


def probed(chunks: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """(row, block, levels): the levels of each chunk's distinct n-grams, as bytes, in the order _dealt() gives."""

    def ask(batches):
        for batch in batches:
            for row, texts in zip(batch.column("row").to_pylist(), batch.column("texts")):
                keys = _keys(*tokens_of(texts.values))
                order, own, at = _dealt(keys, blocks)
                keys = keys[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([row] * len(own), pa.int64()), pa.array([keys[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["block", "row", "keys"]
                )

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        words = _joined(own.column("bits"), np.uint64)
        keys = _joined(asked.column("keys"), np.uint64)
        level = levels_in(words, keys, np.zeros(len(keys), np.int64), np.full(len(keys), len(words))).astype(np.uint8)
        at = np.cumsum([0, *(len(x) // 8 for x in asked.column("keys").to_pylist())])
        return pa.table([asked.column("row"), asked.column("block"), pa.array([level[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["row", "block", "levels"])

    asked = chunks.select("row", "texts").mapInArrow(ask, "block long, row long, keys binary")
    return asked.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(answer, "row long, block long, levels binary")


def score_documents(docs: DataFrame, mix: float = 0.5, most_mb: int = 128, hot_words: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Needs doc_id and text. A null or empty text is its end alone. Repeated rows are scored, and learnt from, each. With
    nothing to learn from, train_tokens is 0 and no token is known.
    """
    spark = ready(docs.sparkSession)
    uni = cut(count(docs, 1), "unigrams")
    begin = F.col("key") == int(BEGIN)
    total, vocabulary = uni.where(~begin).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-total // BLOCK_TOKENS))
    bi = _counted(docs, 2, lambda keys, n: _packed(keys, n, blocks), PACKED)
    bits = cut(built(packed(uni, blocks, -1).union(bi)), "filter")
    whole = bits.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0] <= most_mb << 20

    # The counts from which on at most hot_words words are: by powers of 2, then exactly within the bound.
    left, least = hot_words, 1 << 62
    for r in sorted(uni.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("p")).count().collect(), key=lambda r: -r["p"]):
        left -= r["count"]
        if left < 0:
            break
        least = 1 << int(r["p"])
    hot = uni.where((F.col("n") >= least) & ~begin).toPandas().sort_values("key")
    sent = spark.sparkContext.broadcast((collected(bits, blocks) if whole else None, hot["key"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)))
    norm = total + 0.1 * (vocabulary + 1)
    step = F.expr("cast(length(bin(n)) - 3 as int)")  # of the two bits behind a count's first one
    lows = F.when(F.col("n") <= 8, F.col("n")).otherwise(F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), step), step))
    begin_level = level_of(np.array([uni.where(begin).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]]), UNI)[0]
    share = float(uni.where(~begin).agg(F.coalesce(F.sum(lows), F.lit(0))).first()[0]) + 0.1 * (vocabulary + 1)

    def scored(first_row, doc, texts, levels_of):
        _, hot_keys, hot_n = sent.value
        tokens, size = tokens_of(texts)
        first = np.cumsum(size) - size
        keys, of = np.unique(tokens, return_inverse=True)
        signed = keys.view(np.int64)
        where = np.searchsorted(hot_keys, signed)
        known = where < len(hot_keys)
        known[known] = hot_keys[where[known]] == signed[known]
        n = np.zeros(len(keys), np.int64)
        n[known] = hot_n[where[known]]
        # The level of a frequent word follows from its count, whose levels are many; those of others are in the filter.
        own = level_of(n, UNI)
        own[~known] = levels_of(keys[~known])
        sure = np.where(known, np.log10((n + 0.1) / norm), 0.0)
        # The model: the token's own share, and its share behind its history.
        history, pair = pairs_of(tokens, size)
        pairs, of_pair = np.unique(pair, return_inverse=True)
        before = np.empty(len(tokens), np.int64)
        before[1:] = own[of][:-1]
        before[first] = begin_level
        p = (lowest(own, UNI)[of] + 0.1) / share
        behind = np.minimum(1.0, lowest(levels_of(pairs), BI)[of_pair] / np.maximum(highest(before, UNI), 1))
        p = np.where(before > 0, (1 - mix) * p + mix * behind, p)
        rare = ~known[of]
        n_rare = np.add.reduceat(rare, first, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(first_row + np.arange(len(size))),
                doc,
                pa.array(~learns(doc.to_pylist())),
                pa.array(size.astype(np.int64)),
                pa.array(size - n_rare),
                pa.array(np.add.reduceat(sure[of], first)),
                pa.array(np.add.reduceat(np.log10(p), first)),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_rare))).astype(np.int32)), pa.array(tokens[rare].view(np.int64))),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
        )

    def run(batches):
        at, base = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield scored(base + at, part.column(0), part.column(1), sent.value[0].levels)
                at += part.num_rows

    def run_chunk(levels: pa.Table, chunk: pa.Table) -> pa.Table:
        texts = chunk.column("texts").combine_chunks().values
        keys = _keys(*tokens_of(texts))
        found = np.empty(len(keys), np.int64)
        found[_dealt(keys, blocks)[0]] = _joined(levels.sort_by("block").column("levels"), np.uint8)
        doc = chunk.column("doc_ids").combine_chunks().values
        return pa.Table.from_batches([scored(chunk.column("row")[0].as_py(), doc, texts, lambda some: found[np.searchsorted(keys, some)])])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    if whole:
        rows = cut(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema), "scored")
    else:
        chunks = cut(_chunks(docs), "chunks")
        rows = cut(probed(chunks, bits, blocks).groupBy("row").cogroup(chunks.groupBy("row")).applyInArrow(run_chunk, schema), "scored")
    rare = rows.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("tf"))
    found = rare.join(uni.where(~begin), "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10((F.col("c") + F.lit(0.1)) / F.lit(norm))).alias("more_base"),
    )
    out = rows.drop("rare").join(sums, "row", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), add("base_score", "more_base"), "score")
