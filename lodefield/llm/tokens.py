"""Exact ids of whole texts by the tokenizers library, fast: a worker's distinct pieces are encoded once, as far as it can
remember them.

A byte-level BPE splits at a single space or line break between two other characters, whatever stands around it.
Texts in which all white space is of that kind are cut there; the batch's distinct pieces go to the library, many in one
call, and the texts' ids are gathered from theirs. All other texts
(runs of white space, white space at an end) go to the library as they are. Both ways give the same ids.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOADED: dict = {}
_SIGN = np.isin(np.arange(256), list(string.punctuation.encode()))


def tokenizer(path: str):
    """The tokenizer at path, loaded once in each worker. Strings of special tokens in a text are ordinary text."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        breaks = own.encode("\n", add_special_tokens=False).ids
        kind = own.pre_tokenizer.__class__.__name__ == "ByteLevel" and own.normalizer is None and len(breaks) == 1
        lengths = np.zeros(own.get_vocab_size(), np.int64)  # bytes of each id: a byte-level token has a character for each
        for token, i in own.get_vocab(with_added_tokens=False).items():
            lengths[i] = len(token)
        _LOADED[path] = own, breaks[0] if kind else None, lengths
    return _LOADED[path]


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]], one after the other."""
    total = int(sizes.sum())
    if not total:
        return values[:0]
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(total)]


def _flat(encodings) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.array(e.ids, dtype=np.uint32) for e in encodings]
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.array([len(x) for x in ids], dtype=np.int64)


def _joined(own, line: int, lengths: np.ndarray, words: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and how many each has. Each word is preceded by mark in what is encoded;
    where it ends is told by how many bytes each id stands for."""
    n, step = len(words), 256
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ends = np.minimum(np.arange(0, n + step, step), n).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.cast(pa.string())), mark).to_pylist()
    ids, _ = _flat(own.encode_batch_fast([mark + x for x in texts], add_special_tokens=False))
    size = np.asarray(pc.binary_length(words)).astype(np.int64) + len(mark)
    at, bounds = np.cumsum(lengths[ids]), np.cumsum(size)
    last = np.searchsorted(at, bounds)
    if at[-1] != bounds[-1] or not np.array_equal(at[last], bounds):
        return _flat(own.encode_batch_fast(words.to_pylist(), add_special_tokens=False))
    counts = np.diff(last, prepend=-1)
    if mark:  # one id for each
        first = last - counts + 1
        keep = np.ones(len(ids), bool)
        keep[first] = False
        ids, counts = ids[keep], counts - 1
    return ids, counts


def _pieces(own, line: int, lengths: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and for each word where its ids start and how many they are."""
    spaced = np.asarray(pc.starts_with(words, " "))
    order = np.concatenate((np.flatnonzero(spaced), np.flatnonzero(~spaced)))
    ids, counts = _joined(own, line, lengths, words.filter(pa.array(spaced)), "")
    more, n = _joined(own, line, lengths, words.filter(pa.array(~spaced)), "\n")
    ids, counts = np.concatenate((ids, more)), np.concatenate((counts, n))
    starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    starts[order], sizes[order] = np.cumsum(counts) - counts, counts
    return ids, starts, sizes


def _parted(words: pa.Array) -> pa.Array:
    """The words, marked where signs follow letters up to the end: only those that end in an ASCII sign are looked at."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(1, np.uint8)
    last = np.where(ends[1:] > ends[:-1], raw[np.maximum(ends[1:] - 1, 0)], 0)
    sign = _SIGN[last]
    if not sign.any():
        return words
    mask = pa.array(sign)
    return pc.replace_with_mask(words, mask, pc.replace_substring_regex(words.filter(mask), r"^( ?\pL+)([^\s\pL\pN]+)$", "\\1\x1e\\2"))


class Known:
    """The pieces that a worker has met, and their ids: what is met again isn't encoded again. Beyond `most` pieces those
    that were not met again go."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.words = most, pa.array([], pa.large_string())
        self.ids, self.first, self.size, self.again = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool)

    def ids_of(self, own, line: int, lengths: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _pieces()."""
        at = pc.index_in(words, value_set=self.words)
        new = np.asarray(at.is_null())
        where = np.empty(len(words), np.int64)
        where[~new] = np.asarray(at.drop_null())
        self.again[where[~new]] = True
        fresh = words.filter(pa.array(new))
        ids, first, size = _pieces(own, line, lengths, fresh)
        where[new] = len(self.words) + np.arange(len(fresh))
        self.words = pa.concat_arrays([self.words, fresh])
        self.first, self.size = np.concatenate((self.first, first + len(self.ids))), np.concatenate((self.size, size))
        self.ids, self.again = np.concatenate((self.ids, ids)), np.concatenate((self.again, np.zeros(len(fresh), bool)))
        out = self.ids, self.first[where], self.size[where]
        if len(self.words) > self.most:
            keep = self.again if self.again.sum() <= self.most // 2 else np.zeros(len(self.again), bool)
            self.ids = _ragged(self.ids, self.first[keep], self.size[keep])
            self.words, self.size = self.words.filter(pa.array(keep)), self.size[keep]
            self.first, self.again = np.cumsum(self.size) - self.size, np.zeros(len(self.size), bool)
        return out


def known(path: str, most: int = 1 << 18) -> Known:
    """The pieces that this worker knows of the tokenizer at path, over all its tasks."""
    return _LOADED.setdefault((path, most), Known(most))


def encode(texts: pa.Array, path: str, met: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one text after the other, and how many each has. A null text has none. met: the pieces that
    need not be encoded again."""
    own, line, lengths = tokenizer(path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # Python's and the library's notions of white space differ in a few control characters: all of them count here.
    odd = np.asarray(pc.match_substring_regex(texts, r"^$|^[\s\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}]([\s\x0b\x1c-\x1f\x85\p{Z}]|$)|[\x1e\x1f]"))
    if line is None:
        odd = np.ones(n, bool)
    plain = np.flatnonzero(~odd)
    values, starts, sizes, of_text = [], [], [], []
    if len(plain):
        # A piece after a space keeps it; a line's first piece has none. The line break is a piece of its own.
        marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), " ", "\x1e "), "\n", "\x1e\x1f\x1e")
        lists = pc.split_pattern(marked, "\x1e")
        coded = lists.flatten().dictionary_encode()
        # Signs behind a word are split from it too: fewer distinct words are left.
        parts = pc.split_pattern(_parted(coded.dictionary), "\x1e")
        words = parts.flatten().dictionary_encode()
        breaks = pc.index(words.dictionary, pa.scalar("\x1f", pa.large_string())).as_py()
        ids, first, size = met.ids_of(own, line, lengths, words.dictionary) if met else _pieces(own, line, lengths, words.dictionary)
        first, size = first.copy(), size.copy()
        if breaks >= 0:  # it stands for one line break
            ids = np.append(ids, np.uint32(line))
            first[breaks], size[breaks] = len(ids) - 1, 1
        at = np.asarray(words.indices)
        ids, size = _ragged(ids, first[at], size[at]), np.add.reduceat(size[at], np.asarray(parts.offsets[:-1]).astype(np.int64))
        first = np.cumsum(size) - size
        at = np.asarray(coded.indices)
        values.append(_ragged(ids, first[at], size[at]))
        sizes.append(np.add.reduceat(size[at], np.asarray(lists.offsets[:-1]).astype(np.int64)))
        of_text.append(plain)
    rest = np.flatnonzero(odd)
    if len(rest):
        ids, size = _flat(own.encode_batch_fast(texts.take(pa.array(rest)).to_pylist(), add_special_tokens=False))
        values.append(ids)
        sizes.append(size)
        of_text.append(rest)
    every, size, order = np.concatenate(values), np.concatenate(sizes), np.concatenate(of_text)
    if len(rest) and len(plain):
        first = np.cumsum(size) - size
        back = np.argsort(order, kind="stable")
        return _ragged(every, first[back], size[back]), size[back]
    return every, size
