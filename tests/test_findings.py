"""What reviews found, in small."""

import hashlib

from lodefield.functions import documents
from lodefield.operators import digests
from lodefield.plans import catalog


def test_windows_keep_digits_at_ends_of_sentences(spark):
    """Sentence 1 begins with a 1 and ends with one; sentences 2 and 3 with their numbers too."""
    text = "One. 1.2.3.1 begins so. 22 two ends in 2. 3 is 33"
    df = spark.createDataFrame([(text,)], "t string").select(documents.windows(documents.F.col("t")))
    assert df.first()[0] == ["One. 1.2.3.1 begins so. 22 two ends in 2.", "22 two ends in 2. 3 is 33"]


def test_digests_of_all_ids_in_order(spark):
    """Pieces of three ids, a null group, a group of null ids; and the query's fingerprint is the digest of its ids."""
    rows = [("a", i) for i in range(40)] + [("a", 7), (None, 5), (None, 12), ("z", None)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(5)
    want = {g: hashlib.sha256(",".join(sorted(str(i) for h, i in rows if h == g and i is not None)).encode()).hexdigest() for g in ("a", None, "z")}
    assert {r["g"]: r["sha256"] for r in digests.ids_sha256(df, "g", "i", joined=3).collect()} == want
    sf = "/root/testdata/sf0.001"
    of: dict = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id").collect():
        of.setdefault(r["source"], []).append(str(r["doc_id"]))
    got = {r["source"]: r["fingerprint"] for r in catalog.QUERIES["model_watermark"](spark, sf).collect()}
    assert got == {s: hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest() for s, ids in of.items()}


def test_many_claims_are_not_sent_whole(spark, monkeypatch):
    """Joins with more rows than are to be sent are dealt out, though their files are small; the results are those of few."""
    from lodefield.operators import graph, lineage

    edges = lineage.written(spark.range(1, 4000).selectExpr("id div 3 as a", "id as b").where("a <> b"))
    seeds = spark.range(1, 3).selectExpr("id as node")
    few = graph.reached(edges, seeds).collect()
    monkeypatch.setattr(lineage, "MOST_SENT", 10)
    rounds = []
    keep = lineage.written
    monkeypatch.setattr(graph, "written", lambda df, tag="round": rounds.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, tag))
    assert sorted(graph.reached(edges, seeds).collect()) == sorted(few) and len(few) == 3999
    assert not any("BroadcastHashJoin" in p for p in rounds[4:]) and "ShuffledHashJoin" in rounds[4]


def test_ledgers_are_not_a_data_frame_each(spark):
    from lodefield.operators import ledger

    rows = [(o, s, f"k{s % 3}", "the Thing", None if s % 2 else 1.0, "q" * s) for o in (1, 2, None) for s in range(6)]
    df = spark.createDataFrame(rows, "owner long, seq long, key string, entity string, value double, quote string")
    out = ledger.deduplicated(df)
    assert sorted(out.collect(), key=str) == sorted([(1, 4), (2, 4), (None, 4)], key=str)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_knots_without_frames_to_the_end(spark):
    """Each row's knots; and no window has a frame to the last row, which is read anew for every row."""
    from lodefield.operators import ranges

    knots = spark.range(0, 50).selectExpr("cast(id * 10 as double) as x", "id as k")
    rows = spark.range(0, 600).selectExpr("id", "cast(id as double) - 20 as at")
    found = ranges.around(rows, knots, "at")
    assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert (r["below"] and r["below"]["k"]) == (None if r["at"] < 0 else min(49, r["at"] // 10))
        assert (r["above"] and r["above"]["k"]) == (None if r["at"] > 490 else max(0, -(-r["at"] // 10)))


def test_draws_are_those_of_python():
    import random
    from itertools import islice

    from lodefield.operators import evaluation

    for n, size in ((1, 3), (2, 7), (7, 7), (1000, 1000), (1 << 16, 50), ((1 << 31) + 5, 9)):
        rng = random.Random(1234)
        got = [d.tolist() for d in islice(evaluation.draws(1234, n, size), 40)]
        assert got == [[rng.randrange(n) for _ in range(size)] for _ in range(40)]


def test_rounds_of_a_rank_send_nodes_not_edges(spark, monkeypatch):
    """Ranks of many cells are those of one; a round reads its cells as they lie and deals out rows by node alone."""
    from lodefield.operators import graph, lineage

    edges = spark.range(0, 6000).selectExpr("id % 40 as a", "100 + (id * 7) % 150 as b", "1.0D + id % 3 as weight").union(spark.sql("select 100L, 3L, 2.0D"))
    reset = spark.range(0, 40).selectExpr("id as node", "cast(id % 7 = 0 as double) as reset")
    one = dict(map(tuple, graph.rank_conserved(edges, reset).collect()))
    monkeypatch.setattr(graph, "CELL_EDGES", 10)
    plans, keep = [], lineage.written
    monkeypatch.setattr(graph, "written", lambda df, tag="round": plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, tag))
    many = dict(map(tuple, graph.rank_conserved(edges, reset).collect()))
    assert many.keys() == one.keys() and all(abs(many[k] - one[k]) < 1e-12 for k in one) and abs(sum(one.values()) - 1) < 1e-9
    assert "Bucketed: true" in plans[-1] and not any("Exchange hashpartitioning(a" in p or "Exchange hashpartitioning(cell#" in p and "REPARTITION" not in p for p in plans[3:])
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true" and not [t for t in spark.catalog.listTables() if t.name.startswith("lodefield_")]


def test_strongest_terms_without_a_row_for_a_pair(spark):
    """The embeddings are those of associations(), ties and repeated tokens too; what is dealt out has a row for each term of a
    document."""
    import random

    import numpy as np
    import pandas as pd

    from lodefield.operators import words

    rng = random.Random(5)
    vocabulary = [a + b + c for a in "abcdefg" for b in "xyz" for c in "mn"]
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(60)] + [("none", None)], "doc_id string, text string")
    pairs = words.associations(docs, 2, 20, 1, 0.25).collect()
    both = [(p["ppmi"], p["a"], p["b"]) for p in pairs] + [(p["ppmi"], p["b"], p["a"]) for p in pairs]
    near = {t: [(b, min(w / 4, 0.5)) for w, a, b in sorted((x for x in both if x[1] == t), key=lambda x: (-x[0], x[2]))[:4]] for t in vocabulary}
    assert any(len(v) == 4 for v in near.values())
    got = {r["doc_id"]: np.array(r["embedding"]) for r in words.contextual_embeddings(docs, 32, 2, 20).collect()}
    for doc_id, text in docs.collect():
        tokens = (text or "").split()
        want, added = words.hashed(tokens, 32), sorted(x for t in tokens for x in near[t])
        if added:
            want = 0.75 * want + 0.25 * sum(w * words.hashed([b], 32) for b, w in added)
            want /= np.sqrt((want * want).sum())
        assert np.allclose(got[doc_id], want, atol=1e-12), doc_id
    rows = [pd.DataFrame({"x": [7, 7, 9], "ys": [[7, 9, 13], [7, 9], [7, 9]]}), pd.DataFrame({"x": [9, 13], "ys": [[7, 9], [7, 13]]})]
    import pyarrow as pa

    out = [tuple(r.values()) for b in words._strongest(6, 1)(pa.RecordBatch.from_pandas(r) for r in rows) for r in b.to_pylist()]
    assert out == [(7, 13, 1), (9, 7, 2), (13, 7, 1)]  # df: 7 and 13 have 1, 9 has 3


def test_tokens_are_hashed_by_batches(spark, monkeypatch):
    """Rows' embeddings and products are those of hashed(), in pieces of few tokens too; the tokens do not come back."""
    import numpy as np
    import pyarrow as pa

    from lodefield.operators import words

    rows = [["a", "b", "a"], [], None, ["c"] * 7, ["é", "a"], ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    monkeypatch.setattr(words, "MOST_TOKENS", 4)
    parts = words.pieces(batch, 1)
    assert len(parts) > 2 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and words.pieces(batch.slice(0, 0), 1)[0].num_rows == 0
    assert np.array_equal(np.vstack([words.hashed_rows(p.column(1), 8) for p in parts]), [words.hashed(r or [], 8) for r in rows])
    q = words.hashed(["a", "c"], 8)
    df = words.likeness(spark.createDataFrame(list(enumerate(rows)), "doc_id long, tokens array<string>"), q.tolist(), 8)
    assert df.columns == ["doc_id", "score"]
    assert sorted(map(tuple, df.collect())) == [(i, float(words.hashed(r or [], 8) @ q)) for i, r in enumerate(rows)]


def test_embeddings_of_all_associations(spark, tmp_path, monkeypatch):
    """The query's associations are those of all terms: of one document, of more than 200, of copies and of equal doc_ids."""
    import random

    import numpy as np
    import pyarrow as pa

    from lodefield.operators import words

    rng = random.Random(3)
    frequent, rare = [f"often{c}" for c in "abcd"], [f"seldom{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(rng.sample(frequent, rng.randint(1, 3)) + rng.choices(rare, k=rng.randint(0, 4))) for _ in range(420)]
    texts += [texts[5]] * 7 + ["twin pair"] * 3 + ["oftena twin zz once", "", "onlya onlyb onlyc onlyd onlye onlyf often" + "a"] + ["oftena oftenb oftena"] * 40
    rows = [(i // 10, i % 10, "user", x) for i, x in enumerate(texts)] + [(0, 0, "user", "oftenc again"), (None, None, "user", "oftend again other"), (1, 99, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    numbered = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, text string")
    pairs = words.associations(numbered, 1, len(rows), 1, 0.25).collect()
    both: dict = {}
    for p in pairs:
        both.setdefault(p["a"], []).append((-p["ppmi"], p["b"]))
        both.setdefault(p["b"], []).append((-p["ppmi"], p["a"]))
    near = {t: [(b, min(-w / 4, 0.5)) for w, b in sorted(x)[:4]] for t, x in both.items()}
    df = {t: sum(t in (r[3] or "").split() for r in rows) for t in near}
    assert any(df[t] > 200 for t in near) and any(df[b] > 200 for x in near.values() for b, _ in x) and any(df[b] == 1 for x in near.values() for b, _ in x)
    want = []
    for c, turn, _, text in rows:
        tokens = (text or "").split()
        own, added = words.hashed(tokens, 64), [x for t in tokens for x in near.get(t, [])]
        if added:
            own = 0.75 * own + 0.25 * sum(w * words.hashed([b], 64) for b, w in added)
            own /= np.sqrt((own * own).sum())
        want.append(("-".join(str(x) for x in (c, turn) if x is not None), own.tolist()))
    got = sorted((r["doc_id"], r["embedding"]) for r in catalog.QUERIES["contextual_embeddings"](spark, str(tmp_path)).collect())
    by = lambda pairs: sorted((k, tuple(round(x, 9) + 0.0 for x in v)) for k, v in pairs)
    assert len(got) == len(want) and by(got) == by(want)
    # Of a list that goes on over batches a row for each y is held; lists are cut where they are many numbers.
    batch = lambda **c: pa.RecordBatch.from_pydict(c)
    rows = [batch(x=[9], ys=[[7, 14]], docs=[2]), batch(x=[9], ys=[[7]], docs=[1]), batch(x=[9, 14], ys=[[14], [7]], docs=[1, 1])]
    flat = lambda out: [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert flat(words._strongest(6, 1)(iter(rows))) == [(9, 7, 3), (14, 7, 1)]  # df: 7 has 1, 9 has 3, 14 has 2
    lists = [batch(docs=[1, 2], ys=[[7, 13, 19, 21], [14, 21]])]
    assert flat(words._sure(6, 2)(iter(lists))) == [(7, 13), (7, 19), (13, 7), (13, 19), (19, 7), (19, 13), (21, 7), (21, 13)]
    lists = [batch(docs=[1], ys=[[7, 13, 19, 21]], lasts=[[19, words.NO_LAST, 13, 13]])]
    sent = [(7, [13, 19], 1), (13, [7, 19, 21], 1), (19, [7, 13], 1), (21, [7, 13], 1)]
    assert flat(words._sent(6)(iter(lists))) == sent
    monkeypatch.setattr(words, "MOST_TOKENS", 2)
    assert flat(words._sent(6)(iter(lists))) == sent
