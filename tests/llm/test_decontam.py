"""Benchmark decontamination against brute force over odd texts, its way over blocks, and what is removed."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from lodefield.llm import decontam

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(raw)]


def brute(docs, items):
    wins = {}
    for item, text in items:
        ws = [w for w, _, _ in words(text)]
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1):
            if n:
                wins.setdefault(tuple(ws[i : i + n]), set()).add(item)
    out = []
    for text in docs:
        own = words(text)
        ws, hit, found = [w for w, _, _ in own], set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                if (got := wins.get(tuple(ws[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in got if x is not None}
        ids = ",".join(sorted(found))
        out.append((len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def odd():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "漢字", "ß", "İ", "x" * 5000, "y"]
    line = lambda n, sep=" ": sep.join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(8, 30))) for i in range(30)] + [(100, "Alpha beta"), (101, "ALPHA, beta"), (2, line(12)), (None, line(14)), (103, None), (104, ""), (105, "?! --"), (106, "solo")]
    docs = [line(rng.randint(0, 120)) for _ in range(60)]
    for _, text in items:
        docs += [text, f"{line(7)}. {(text or '').upper()}! {line(4)}", (text or "").replace(" ", "\n-\t"), (text or "")[:40]]
    docs += [None, "", " \x00\x7f ", "alpha alpha beta beta", "solo" * 3, "solo solo", line(20000), "z" * 3_000_000 + " alpha beta " + "q " * 200_000]
    return docs, items


@pytest.mark.parametrize("most_words", [decontam.MOST_WORDS, 90])
def test_against_brute_force(spark, most_words):
    docs, items = odd()
    a = spark.createDataFrame([(i // 2 if i % 7 else None, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_hit string")
    got = sorted(map(tuple, decontam.digests(a, b, most_words).collect()), key=str)
    want = sorted([(i // 2 if i % 7 else None, *x) for i, x in enumerate(brute(docs, items))], key=str)
    assert got == want


def test_blocks_of_bytes_and_long_words():
    """Hashes don't depend on where a block starts, nor on what stands before a word."""
    text = " ".join(f"a{i % 1000}" for i in range(400_000)) + " " + "b" * 2_000_000 + " a7"
    w = decontam.words_in(pa.array(["a7 a9", None, text]))
    h = decontam.hashed(w)
    assert w.first.tolist() == [0, 2, 2, 400_004] and h[0] == h[2 + 7] == h[2 + 399_007] == h[-1] and len(set(h[2:1002].tolist())) == 1000


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it, {item.upper()}; after é it. " + "more " * 40, 5), (2, item, 5), (3, None, 5), (4, "clean words", 5), (4, "clean words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").selectExpr("doc_id", "text", "row", "1 as runs", "2 as own", "'k' as items")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontam.clean(docs, bench)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"]) for r in out.where("doc_id != 3").collect())
    assert got == [(1, "Before it, ; after é it. " + "more " * 40), (4, "clean words"), (4, "clean words")]
    assert out.where("doc_id = 3").first()["text"] is None
    assert {r["doc_id"] for r in decontam.clean(docs, bench, most_share=0.0).collect()} == {3, 4}
    assert decontam.clean(docs, bench, most_share=1.0).where("doc_id = 2").first()["text"] == ""


def test_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.digests(odd_docs, bench).where("contaminated or n_items > 0").count() == 0
    assert decontam.digests(odd_docs, bench).count() == odd_docs.count()
    assert decontam.digests(no_docs, bench).count() == 0 and decontam.clean(no_docs, bench).columns == no_docs.columns
