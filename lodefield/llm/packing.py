"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Bin after bin is filled: of the waiting examples that fit, the one whose (tokens, 1, loss) has the largest dot product
with what is left of the bin's three limits goes in next (Panigrahy and others, "Heuristics for vector bin packing").
Where cutting is allowed and nothing fits whole, the best example's head fills the bin and its tail waits on.

Each task packs its own examples, in windows, and no shuffle is needed. A sequence's id is the task's number shifted by
40 bits plus a count; a task that runs again reads the same rows in the same order and gives the same ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import ready
from .tokens import encode, known


@dataclass(frozen=True)
class Limits:
    """Of each sequence. loss is also in tokens."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> np.ndarray:
    """Rows (example, start, length, sequence, offset) of the packed examples, sequences from 0.

    The loss-bearing tokens of an example are its last ones. An example that exceeds a limit alone is cut where cut is
    set and gets a sequence of its own otherwise. Examples without tokens get no row. Ties: the earlier example.
    """
    T, S, L = limits.tokens, limits.segments, limits.loss
    left, want, start = tokens.astype(np.int64), np.minimum(loss, tokens).astype(np.int64), np.zeros(len(tokens), np.int64)
    rows: list[np.ndarray] = []
    n_seq = 0
    if cut and L >= T:  # whole sequences of one example
        full = np.maximum(left - 1, 0) // T if S == 1 else left // T
        if full.any():
            who = np.repeat(np.arange(len(left)), full)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
            rows.append(np.stack([who, nth * T, np.full(len(who), T), np.arange(len(who)), np.zeros(len(who), np.int64)], 1))
            n_seq, start, left = len(who), full * T, left - full * T
            want = np.minimum(want, left)
    elif not cut:
        big = np.flatnonzero((left > T) | (want > L))
        if len(big):
            rows.append(np.stack([big, start[big], left[big], np.arange(len(big)), start[big]], 1))
            n_seq, left = len(big), left.copy()
            left[big] = 0
    ids = np.flatnonzero(left)
    left, want, start = left[ids], want[ids], start[ids]
    out: list[tuple[int, int, int, int, int]] = []
    while len(ids):
        t, s, l, at = T, S, L, 0
        gone = []
        waiting = np.ones(len(ids), bool)
        while s and t:
            fits = waiting & (left <= t) & (want <= l)
            score = left * (t / T / T) + want * (l / L / L)  # the segment's part is the same for all
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
                size = int(left[k])
                out.append((int(ids[k]), int(start[k]), size, n_seq, at))
                l -= int(want[k])
                waiting[k] = False
                gone.append(k)
            elif cut and waiting.any():
                k = int(np.argmax(np.where(waiting, score, -1.0)))
                size = min(t, int(left[k] - want[k]) + l)
                if size <= 0:
                    break
                out.append((int(ids[k]), int(start[k]), size, n_seq, at))
                left[k] -= size
                l -= max(0, int(want[k] - left[k]))
                want[k] = min(want[k], left[k])
                start[k] += size
            else:
                break
            t, s, at = t - size, s - 1, at + size
        n_seq += 1
        if gone:
            ids, left, want, start = (x[waiting] for x in (ids, left, want, start))
    if out:
        rows.append(np.array(out, np.int64))
    return np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 0, window: int = 512, with_ids: bool = False) -> DataFrame:
    """Every document's ids and end_id, in pieces of sequences. Needs doc_id and text; other columns are not read.

    A null or empty text is end_id alone. Repeated rows are packed each; a null doc_id stays null. No rows: no pieces.
    The first id of a document bears no loss, as nothing stands before it. with_ids adds the pieces' ids.
    """
    ready(docs.sparkSession)

    def run(batches):
        at = 0
        base, met = TaskContext.get().partitionId() << 40, known(path, 1 << 17)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, size = encode(part.column(1), path, met)
                ends = np.cumsum(size)
                ids = np.insert(ids, ends, np.uint32(end_id))
                size = size + 1
                first = np.cumsum(size) - size
                doc = part.column(0)
                for w in range(0, len(size), window):
                    own = size[w : w + window]
                    rows = pack(own, own - 1, limits, cut=True)
                    who, start, length, seq, off = rows.T
                    who = who + w
                    lo_ids = first[who] + start
                    crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(lo_ids.tolist(), length.tolist())), np.int64, len(rows))
                    cols = [doc.take(pa.array(who)), start, length, crc, size[who], base + at + seq, off, length - (start == 0)]
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
                    if with_ids:
                        cols.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(lo_ids.tolist(), length.tolist())], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)
                    at += int(seq.max()) + 1

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack_examples(examples: DataFrame, limits: Limits = Limits(), window: int = 1024) -> DataFrame:
    """Examples (example_id, tokens, loss), never cut, as (example_id, tokens, loss, sequence_id, offset, segment).

    A null count counts as 0. An example that exceeds a limit alone gets its own sequence; one without tokens gets the
    sequence id null.
    """
    ready(examples.sparkSession)

    def run(batches):
        at, base = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, window):
                part = batch.slice(lo, window)
                tokens, loss = (np.asarray(part.column(i)).astype(np.int64) for i in (1, 2))
                rows = pack(tokens, loss, limits, cut=False)
                who, _, _, seq, off = rows.T
                segment = np.zeros(len(rows), np.int64)
                for i in range(1, len(rows)):
                    segment[i] = segment[i - 1] + 1 if seq[i] == seq[i - 1] else 0
                none = np.setdiff1d(np.arange(part.num_rows), who)
                every = np.concatenate((who, none))
                pad = lambda x: pa.array([*x.tolist(), *[None] * len(none)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(every)), pa.array(tokens[every]), pa.array(loss[every]), pad(base + at + seq), pad(off), pad(segment)], names=["example_id", "tokens", "loss", "sequence_id", "offset", "segment"])
                at += int(seq.max()) + 1 if len(rows) else 0

    cols = ["cast(example_id as long) example_id", "cast(coalesce(tokens, 0) as long) tokens", "cast(coalesce(loss, 0) as long) loss"]
    return examples.selectExpr(*cols).mapInArrow(run, "example_id long, tokens long, loss long, sequence_id long, offset long, segment long")
