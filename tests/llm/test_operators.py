"""The ten operators against brute force, and their defined results on odd rows."""

import collections
import glob
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from lodefield.llm import chats, idstore, jaccard, linededup, lm, mixing, packing, quality, queries, sharding, tokens, vectors
from lodefield.llm.shared import new_path

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True).astype(str) for x in (got, want))
    assert a.equals(b)


def brute_components(texts):
    sets, root = [], list(range(len(texts)))
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [top(i) for i in range(len(sets))]


def test_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)
    n, comp = brute_components(docs["text"])
    got = queries.op1_ngram_jaccard_join(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    assert got["n_shingles"].tolist() == n
    assert got["component_id"].tolist() == [docs["doc_id"][i] for i in comp]


def test_jaccard_chain(spark):
    """Neighbours of a chain link, its ends do not: one component."""
    base = [f"t{i}" for i in range(100)]
    rows = [(k, " ".join(base[3 * k : 3 * k + 70])) for k in range(10)]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    _, comp = brute_components([t for _, t in rows])
    assert got.sort_values("doc_id")["component_id"].tolist() == comp


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_sharding(spark, SF).toPandas()
    text = dict(docs.select("doc_id", "text").collect())
    for r in got.itertuples():
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 40)
    assert 0 < (got["grown_shard"] == 40).sum() < len(got) / 5
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_confines_movement(spark):
    """More weight for one shard moves rows only into its region, and within that only into its rack and itself."""
    own = sharding.tree(40)
    more = tuple(sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in own)
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    a, b = (sharding.placed(keys, "doc_id", t).toPandas() for t in (own, more))
    moved = a["region"] != b["region"]
    assert moved.any() and (b["region"][moved] == 0).all()
    inside = ~moved & (a["rack"] != b["rack"])
    assert (b["rack"][inside] == 1).all()


def test_tokens():
    own = tokens.tokenizer(queries.vocabulary())[0]
    texts = ["", " a", "a  b\n\nc", None, "x\ty", "a \n b", "<|endoftext|> q", "é b", "\x1f", "a\x1eb", "ends\n", "It's fine, isn't it?\nYes.", "a b c", "漢字 test! (ok)"]
    ids, n = tokens.encode(pa.array(texts), queries.vocabulary())
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing(spark, odd_docs):
    own = tokens.tokenizer(queries.vocabulary())[0]
    got = packing.pack_documents(odd_docs, queries.vocabulary(), with_ids=True).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 1024 and len(g) <= 64
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
    for doc, text in odd_docs.where("doc_id is not null and doc_id <> 9").select("doc_id", "text").collect():
        g = got[got["doc_id"] == doc].sort_values("start")
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        assert [i for x in g["ids"] for i in x] == ids and (g["doc_tokens"] == len(ids)).all()
        assert g["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4")) for x in g["ids"]]


def test_packing_limits():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 500, 400)
    loss = (size * rng.random(400)).astype(int)
    for cut in (False, True):
        rows = packing.pack(size, loss, packing.Limits(600, 5, 300), cut)
        assert np.bincount(rows[:, 0], rows[:, 2], 400).astype(int).tolist() == size.tolist()
        for s in np.unique(rows[:, 3]):
            own = rows[rows[:, 3] == s]
            tail = np.minimum(own[:, 2], np.maximum(0, own[:, 1] + own[:, 2] - (size - loss)[own[:, 0]]))
            alone = not cut and len(own) == 1
            assert alone or (own[:, 2].sum() <= 600 and len(own) <= 5 and tail.sum() <= 300)


def test_store(spark, odd_docs):
    own = tokens.tokenizer(queries.vocabulary())[0]
    docs, to = odd_docs.where("doc_id is not null"), new_path(spark, "test")
    idstore.write_store(docs, to, queries.vocabulary())
    got = idstore.read_digests(spark, to).toPandas().sort_values("start", ignore_index=True)
    at = 0
    for r, (doc, text) in zip(got.itertuples(), sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0], r[1] or ""))):
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)
    assert idstore.verify(spark, to)
    chunks = idstore.chunks(spark, to)
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_permuted_recipe(spark):
    """A recipe whose chunks of equal sizes were swapped still has its stored root, yet is found out."""
    to, words_ = new_path(spark, "test"), np.random.default_rng(5).integers(0, 5000, 60000)
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in words_)), (2, "b c")], "doc_id long, text string")
    idstore.write_store(docs, to, queries.vocabulary())
    assert idstore.verify(spark, to)
    recipes = spark.read.parquet(f"{to}/recipes")
    rows = recipes.toPandas()
    i = int(rows.index[rows["doc_id"] == 1][0])
    sizes, raw = np.frombuffer(rows["sizes"][i], np.int32), rows["digests"][i]
    d = [bytes(raw[k : k + 16]) for k in range(0, len(raw), 16)]
    a, b = next((a, b) for a in range(len(d)) for b in range(a) if sizes[a] == sizes[b] and d[a] != d[b])
    d[a], d[b] = d[b], d[a]
    rows.at[i, "digests"] = b"".join(d)
    other, schema = new_path(spark, "test"), recipes.schema
    spark.createDataFrame([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows.itertuples(index=False)], schema).write.parquet(f"{other}/recipes")
    spark.read.parquet(f"{to}/manifest").write.parquet(f"{other}/manifest")
    idstore.chunks(spark, to).write.parquet(f"{other}/new/kind=chunks")
    assert not idstore.verify(spark, other)
    with pytest.raises(ValueError, match="manifest"):
        idstore.read_digests(spark, other)


def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)
    got = queries.op7_lm_scoring(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in docs["doc_id"]]
    toks = [[*words(t), None] for t in docs["text"]]
    c = collections.Counter(w for t, h in zip(toks, held) if not h for w in t)
    total = sum(c.values())
    base = [sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in t) for t in toks]
    assert got["held_out"].tolist() == held and got["n_tokens"].tolist() == [len(t) for t in toks]
    assert got["n_known"].tolist() == [sum(w in c for w in t) for t in toks] and (got["train_tokens"] == total).all()
    assert np.abs(got["base_score"] - base).max() < 1e-6
    assert got["score"][got["held_out"]].sum() > got["base_score"][got["held_out"]].sum()


def level(n, fine):
    """1 to 2 * fine, then `fine` levels for each doubling, counted up one by one."""
    at = k = 2 * fine
    if n <= k:
        return n
    while n >= at + (step := 2 ** (at.bit_length() - 1) // fine):
        at, k = at + step, k + 1
    return k


def bounds(n, fine):
    """The least and the largest count of n's level."""
    same = [m for m in range(max(1, n // 2), 2 * n + 2) if level(m, fine) == level(n, fine)]
    return (same[0], same[-1]) if n else (0, 0)


def test_levels():
    n = np.array([1, 2, 3, 4, 5, 7, 8, 9, 10, 15, 16, 17, 20, 1000, 123456, 2**40 + 5])
    for fine in (2, 4):
        got = lm.level_of(n, fine)
        assert got.tolist() == [level(int(x), fine) for x in n]
        for x, k in zip(n[:-2].tolist(), got[:-2]):
            assert (int(lm.lowest(k, fine)), int(lm.highest(k, fine))) == bounds(x, fine)


def test_filter_levels(spark):
    keys = np.arange(1, 3001, dtype=np.int64) * 7919
    n = np.where(keys % 5 == 0, 9, 1)
    df = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, n)], "key long, n long")
    for pair in ((df, df.limit(0)), (df.limit(0), df)):
        model, _ = lm.build(*pair)
        found = model.levels(keys.view(np.uint64))
        want = np.where(n == 9, 8 if pair[0] is df else 6, 1)
        assert (found >= want).all() and (found == want).mean() > 0.98
        assert (model.levels(np.arange(10**9, 10**9 + 3000).astype(np.uint64)) == 0).mean() > 0.98


def model_of(texts):
    """Counts of words and pairs, and each word's share, by exact counts read as their levels' bounds."""
    learnt = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    toks = [[*words(t), None] for t in texts]
    uni = collections.Counter(w for t, ok in zip(toks, learnt) if ok for w in [0, *t])
    bi = collections.Counter(p for t, ok in zip(toks, learnt) if ok for p in zip([0, *t], t))
    z = sum(bounds(n, 4)[0] for w, n in uni.items() if w != 0) + 0.1 * len(uni)

    def p(w, h, mix=0.5):
        own = (bounds(uni[w], 4)[0] + 0.1) / z
        return (1 - mix) * own + mix * bounds(bi[h, w], 2)[0] / bounds(uni[h], 4)[1] if uni[h] else own

    return toks, uni, p


def model_scores(texts):
    toks, _, p = model_of(texts)
    return np.array([sum(math.log10(p(w, h)) for h, w in zip([0, *t], t)) for t in toks])


def test_probabilities_sum_to_one_or_a_little_less(spark):
    """Over all words, the end and one unknown word, behind every history: the filter's own scores, word by word."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(vocabulary[min(59, int(k))] for k in rng.exponential(9, 30)) for _ in range(400)]
    toks, uni, p = model_of(texts)
    known = [w for w in uni if w != 0]
    for h in [*(w for w in uni if w is not None), "never seen"]:  # nothing stands behind the end
        total = sum(p(w, h) for w in [*known, "unknown"])
        assert 0.75 <= total <= 1 + 1e-9, (h, total)
    # What the operator gives a text of one word more is the word's probability behind the last.
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 != 0]
    probe = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, texts[i]) for i in learnt]
    words_ = [w.decode() for w in known if w is not None] + ["unknownword"]
    for h in ("w0", "w7"):
        rows += [(probe.pop(), f"{h} {w}") for w in words_] + [(probe.pop(), h)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")["score"]
    ids = [r[0] for r in rows[len(learnt) :]]
    sub = [texts[i] if i in set(learnt) else "" for i in range(400)]
    n = len(words_) + 1
    for k, h in enumerate((b"w0", b"w7")):
        own = ids[k * n : (k + 1) * n]
        # p(h | start) p(w | h) p(end | w) over the model's p(h | start) and p(end | w)
        pairs = [10 ** got[i] / (p(h, 0) * p(None, w.encode())) for i, w in zip(own, words_)]
        total = sum(pairs) + 10 ** got[own[-1]] / p(h, 0)
        assert 0.75 <= total <= 1.08, (h, total)


def few_words(spark):
    """Documents most of whose bigrams occur once."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 40)) for _ in range(200)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_scores_of_bigrams_seen_once(spark):
    texts, docs = few_words(spark)
    got = lm.score_documents(docs).toPandas().sort_values("doc_id")
    # The filter reads few levels too high, none too low.
    assert np.abs(got["score"].to_numpy() - model_scores(texts)).mean() < 2


def test_scores_do_not_depend_on_the_broadcast(spark, odd_docs):
    """A filter that outgrows most_mb leaves no n-gram out: the scores are those of one that does not."""
    texts, docs = few_words(spark)
    a, b = (lm.score_documents(docs, most_mb=m, hot_words=50).toPandas().sort_values("doc_id", ignore_index=True) for m in (128, 0))
    assert a.round(9).equals(b.round(9)) and np.abs(b["score"].to_numpy() - model_scores(texts)).mean() < 2
    a, b = (lm.score_documents(odd_docs, most_mb=m).toPandas().round(9) for m in (128, 0))
    a, b = (x.sort_values(list(x.columns), ignore_index=True) for x in (a, b))
    assert len(b) == 13 and a.equals(b)
    assert lm.score_documents(odd_docs.limit(0), most_mb=0).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + 0.05 * rng.normal(size=(60, 16))
    x[7] = x[6]
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 2 if i < 100 else 0)) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 1), (304, rows[5][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.near_vectors(df, per_cell=64).toPandas().sort_values("vec_id", ignore_index=True)
    y = np.array([r[1] for r in rows[:300]], np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:300]])
    near = (y @ y.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert got["n_links"].tolist()[:300] == near.sum(1).tolist() and got["n_links"].tolist()[300:] == [0] * 5
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_audit_counts_every_query_alike(spark):
    """One large group keeps all its links, small ones lose theirs: the large one's don't make up for that."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(340, 16))
    x[:300] = x[0] + 0.001 * rng.normal(size=(300, 16))
    x[301::2] = x[300::2] + 0.001 * rng.normal(size=(20, 16))
    nodes = spark.createDataFrame([(i, 0, 16, 1, x[i].tolist()) for i in range(340)], "node long, label long, w int, n long, x array<double>")
    found = lambda small: spark.createDataFrame([(i, 299, 0) for i in range(300)] + [(i, small if i % 4 < 2 else 1, i - i % 2) for i in range(300, 340)], "node long, links long, root long")
    assert vectors.audited(nodes, found(1), 0.98, 256) == 1
    assert vectors.audited(nodes, found(0), 0.98, 256) < 0.9


def test_audit_at_the_last_overlap(spark):
    df = spark.createDataFrame([(i, [1.0, 0.001 * i], 0) for i in range(20)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="24 cells"):
        vectors.near_vectors(df, overlap=24, recall=1.1)


def test_mixing(spark):
    rows = [(i, "a b c d e", "big" if i < 900 else f"s{i % 3}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_in(docs, entropy=0.95, repeats=4.0).toPandas()
    share = got["source"].value_counts(normalize=True)
    entropy = -(share * np.log(share)).sum() / math.log(4)
    assert abs(entropy - 0.95) < 0.01 and abs(len(got) - 1200) <= 8
    for _, g in got.groupby("source"):  # no document is taken again before all others were
        times = g["doc_id"].value_counts()
        assert times.max() - (times.min() if len(times) == len({r[0] for r in rows if r[2] == g["source"].iloc[0]}) else 0) <= 1
    once = mixing.mixed_in(docs, least_once=True).select("doc_id").distinct().count()
    assert once == 1200


def test_odd_rows(spark, odd_docs, no_docs):
    """None of them crashes on nulls, empty tables or columns of any name."""
    for docs, n in ((odd_docs, 13), (no_docs, 0)):
        assert jaccard.components(docs).count() == n
        assert sharding.shard_documents(docs, sharding.tree(4), sharding.tree(5)).count() == n
        assert quality.rate_documents(docs).count() == n
        assert linededup.clean(docs).count() == n
        assert lm.score_documents(docs).count() == n
        assert mixing.mixed_in(docs, least_once=True).select("doc_id").distinct().count() <= n
        assert quality.keep_good(docs).columns == docs.columns
        assert jaccard.keep_one(docs).columns == docs.columns
    turns = spark.createDataFrame([(1, None, "user", "a"), (1, 1, None, "b"), (None, 0, "user", "q"), (2, None, "user", "a")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"] for r in chats.render(turns).collect()} == {None, 1}
    assert chats.render(turns.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns
        kept.append((docs.toPandas(), new.toPandas()))
        docs = new
    good = queries.op3_quality_rules(spark, SF).where("kept").toPandas()["doc_id"]
    assert set(kept[0][1]["doc_id"]) == set(good)
    before, after = kept[2]
    before = before.sort_values("doc_id", ignore_index=True)
    _, comp = brute_components(before["text"])
    assert set(after["doc_id"]) == {before["doc_id"][i] for i in comp}
    assert set(kept[3][1]["doc_id"]) == set(after["doc_id"])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert set(packed.toPandas()["doc_id"]) == set(after["doc_id"])


def test_words_of_slices_equal_those_of_whole_arrays():
    """Spark's batches are worked on in slices: a slice behind the first has to give the same words."""
    import pyarrow as pa

    from lodefield.llm.shared import words_of

    texts = pa.array([" Aa b", "c\tD", None, "", "E é F  g", "\n", "h"])
    for lo in range(len(texts)):
        part = texts.slice(lo, 3)
        flat, ends = words_of(part)
        want = [x.lower().split() if x else [] for x in part.to_pylist()]
        assert [flat.to_pylist()[a:b] for a, b in zip(ends[:-1], ends[1:])] == want
