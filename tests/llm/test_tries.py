"""The trie of conversations against brute force, and LOUDS tries against plain ones."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from lodefield.llm import queries, tries

SF = "/root/testdata/sf0.001"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            members.setdefault(own[:d], []).append(c)
    kids, total = {}, {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = (1, 0) if p not in kids else map(sum, zip(*(total[k] for k in kids[p])))
        total[p] = leaves, saved + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids.get(p, [])), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def held(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def odd(seed, n):
    """Few distinct turns, so that prefixes are shared by many; long conversations, copies, ties, nulls, negative ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-n, 3 * n), n):
        size = rng.choice([1, 2, 3, 4, 8, 9, 12, 30])
        own = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", "", None])) for t in range(size)]
        if rng.random() < 0.4:
            own = [(c, t, "user", "same") for t in range(rng.choice([5, 12, 60]))]
        if rng.random() < 0.1:
            own = [(c, None if rng.random() < 0.3 else t // 2, r, x) for _, t, r, x in own] + [own[0]]
        rows += own
    return rows + [(None, 0, "user", "nobody's")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = queries.op13_conversation_trie(spark, SF)
    assert dict(got.dtypes) == {c: "bigint" for c in got.columns} | {"ends_sha256": "string"}
    assert held(got) == brute(rows)


@pytest.mark.parametrize("least,block,upper", [(64, 4096, 250_000), (1, 4, 250_000), (2, 7, 3)])
def test_odd_conversations(spark, monkeypatch, least, block, upper):
    """Shards of a few nodes, blocks of a few turns, and more upper nodes than may be."""
    monkeypatch.setattr(tries, "LEAST", least)
    monkeypatch.setattr(tries, "BLOCK", block)
    monkeypatch.setattr(tries, "MEMBERS", 2)
    rows = odd(least, 150)
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, x string").repartition(3)
    assert held(tries.nodes(frame, most_upper=upper)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, 1, "user", "x")], [(-3, None, None, None)], [(5, 1, "u", "x"), (6, 1, "u", "x")], [(1, 0, "u", "t")] * 3])
def test_small_tables(spark, rows):
    assert held(tries.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_one_conversation_holds_a_third(spark):
    rows = [(3, t, "user", "x" * (t % 7)) for t in range(10_000)] + [(100 + i, t, "user", "x" * (t % 7)) for i in range(2500) for t in range(i % 12)]
    assert held(tries.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_louds():
    rng = random.Random(2)
    paths = {()}
    for _ in range(400):
        p = ()
        for _ in range(rng.randint(1, 9)):
            p += (rng.randint(0, 3),)
            paths.add(p)
    own = sorted(paths - {()}, key=lambda p: rng.random())
    at = {p: i for i, p in enumerate(own)}
    trie = tries.Louds(np.array([at.get(p[:-1], -1) for p in own]), np.array([len(p) for p in own]), np.array([p[-1] for p in own], np.uint64))
    ordered = sorted(own, key=lambda p: (len(p), p))
    assert [own[i] for i in trie.order] == ordered and len(trie.bits) == 2 * len(own) + 1
    assert [trie.find(p) for p in ordered] == list(range(len(own))) and trie.find((9,)) == trie.find(()) == -1
    assert [ordered[i - 1] if i else () for i in trie.parents()] == [p[:-1] for p in ordered]
    values = np.arange(len(own))
    assert trie.rollup(values).tolist() == [sum(v for q, v in zip(ordered, values) if q[: len(p)] == p) for p in ordered]
    empty = tries.Louds(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    assert len(empty.rollup(np.zeros(0, np.int64))) == 0 and empty.find((1,)) == -1
