"""Operators against independent implementations, row by row, and on rows that are odd in every way they can be."""

import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from lodefield.llm import chats, idstore, jaccard, linededup, mixing, packing, quality, queries, sharding, tokens, vectors
from lodefield.llm.shared import connected, new_path

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"w{i}" for i in range(60))
DOCS = "doc_id long, text string, source string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """xxhash64() of Spark: each value's hash is the next one's seed; nulls are passed over."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def test_jaccard_repeated_and_missing_ids(spark):
    """A doc_id of two texts has two sets; rows without an id carry links."""
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, BASE), (5, other), (6, other + " more"), (7, BASE + " more")]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got["component_id"]) == {5} and len(got) == 4
    rows = [(None, BASE), (3, BASE + " more"), (9, "more " + BASE), (None, other), (None, other)]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 56): None, (3, 57): 3, (9, 57): 3} or got[(3, 57)] == got[(9, 57)] == 3


def test_one_of_each_stays(spark):
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, BASE), (5, BASE), (5, other), (6, BASE + " more"), (None, BASE), (None, other + " x"), (None, "alone but for itself"), (None, "alone but for itself"), (8, None), (8, ""), (8, "")]
    got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(got, key=key) == sorted([(5, BASE), (5, other), (None, "alone but for itself"), (8, None), (8, ""), (8, "")], key=key)


def test_near_group_of_many_components(spark):
    """Copies that differ from each other by chance: some pairs link, some just don't."""
    rng = np.random.default_rng(7)
    base, rows = [f"t{i}" for i in range(80)], []
    for k in range(120):
        t = list(base)
        for i in rng.choice(80, 2, replace=False):
            t[i] = f"x{k}_{i}"
        rows.append((k, " ".join(t)))
    from tests.llm.test_operators import brute_components

    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert got["component_id"].tolist() == brute_components([t for _, t in rows])[1]


def test_components_of_chains_and_stars(spark):
    for few in (0, 200_000):
        edges = [(i, i + 1) for i in range(0, 300) if i % 100] + [(1000, 1000 + k) for k in range(1, 50)] + [(1049, 2000)]
        got = {r["id"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(7), few=few).collect()}
        assert got[99] == 1 and got[2000] == 1000 and got[1030] == 1000 and len(set(got.values())) == 4 and got[200] == 101


NAMES = """of b whole state p_of in_source in_doc in_edge mix_b mix_times mix_epoch mix_block mix_at mix_row mix_source mix_doc rest block blocks strict host_rate host_docs host
n_words base_failed soft_failed kept quality_w quality_l quality_row quality_of quality_host word_chars n_lines n_dropped dedup_lines dedup_host dedup_row dedup_of dedup_text dedup_in
jaccard_row keep t id root n key a c rank least top stays first size jaccard_doc""".split()
STAGES = {
    "quality": quality.keep_good,
    "lines": linededup.clean_texts,
    "copies": jaccard.keep_one,
    "mix": lambda d: mixing.mixed_in(d, least_once=True, marks=False),
}


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_columns_of_any_name_come_back(spark, stage):
    """Callers' columns are what they were, whatever the operator calls its own; nulls, repeats and no rows are fine."""
    rows = [(0, BASE, "s"), (1, BASE + " y", "s"), (2, None, None), (3, "", "s"), (4, "one two", None), (4, "one two", None), (None, "q " * 30 + BASE, "t"), (5, "w" * 5000, "t")]
    plain = spark.createDataFrame(rows, DOCS)
    more = plain.selectExpr("*", *(f"cast({i} as int) as `{n}`" for i, n in enumerate(NAMES)), "'x' as `with.dot`")
    got, want = STAGES[stage](more), STAGES[stage](plain)
    assert got.columns == more.columns
    pick = lambda df: sorted(map(str, df.select("doc_id", "text", "source").collect()))
    assert pick(got) == pick(want)
    for r in got.select(*NAMES).collect():
        assert list(r) == list(range(len(NAMES)))
    assert STAGES[stage](more.limit(0)).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, BASE.replace("w3 ", f"z{i} ") if i % 2 else BASE + f" u{i} " * 9, "s" if i % 3 else None, "en", 10) for i in range(30)] + [(None, BASE, "s", "en", 1), (7, None, None, None, None), (8, "", "s", "en", 0)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, n_chars long").withColumn("n_lines", docs_lit(4)).withColumn("mix_epoch", docs_lit(5))
    for name, df in (("odd", docs), ("none", docs.limit(0))):
        (tmp_path / name).mkdir()
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        now = df
        for _, stage in corpus_pipeline.STAGES[:4]:
            now = stage(spark, now, str(tmp_path / name))
            assert now.columns == df.columns
            assert {(r["n_lines"], r["mix_epoch"]) for r in now.collect()} <= {(4, 5)}
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (got.count() > 0) == (name == "odd")


def docs_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_lines_go_alike_where_lists_are_not_broadcast(spark):
    rows = [(i, f"menu\nhome {i}\n{i % 3} of three", "s" if i % 4 else None) for i in range(40)] + [(50, None, "s"), (50, None, "s")]
    docs = spark.createDataFrame(rows, DOCS)
    a, b = (sorted(map(str, linededup.clean(docs, most_lines=n).collect())) for n in (2_000_000, 0))
    assert a == b and sum("menu" in x for x in a) == 0


def test_slots_of_a_common_doc_id(spark):
    """One doc_id on a third of the rows, and rows without one: slots are gapless and each taken once."""
    rows = [(7 if i % 3 else i, "t", "s") for i in range(600)] + [(None, "t", "s")] * 50
    own = sharding.tree(8)
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(6), own, sharding.grown(own), bucket_rows=1).toPandas()
    assert len(got) == 650
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def place(key, shards):
    """A key's region, rack and shard by draws written out anew."""

    def winner(level, weights):
        def draw(node):
            unit = ((spark_hash(key, level, (node,)) >> 11) + 1) / (1 << 53)
            return math.log(unit) / weights[node], -node

        return max(weights, key=draw)

    def below(level, pick):
        out = {}
        for s in shards:
            if pick(s) is not None:
                out[pick(s)] = out.get(pick(s), 0.0) + s.weight
        return winner(level, out)

    region = below("region", lambda s: s.region)
    rack = below("rack", lambda s: s.rack if s.region == region else None)
    return region, rack, below("shard", lambda s: s.shard if s.rack == rack else None)


def test_sharding_places_every_row(spark):
    own = sharding.tree(40)
    got = queries.op2_sharding(spark, SF).collect()
    assert got
    for r in got:
        region, rack, shard = place(r["doc_id"], own)
        assert (r["shard"], r["grown_shard"]) == (shard, place(r["doc_id"], sharding.grown(own))[2])


def test_mixing_takes_the_rows_it_says(spark):
    """Blocks, their order, whole epochs and the rest of each source's budget, written out anew."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["a"] * int(rng.integers(0, 40))), ["big", "mid", "small", None][min(3, int(rng.exponential(0.8)))]) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(tuple(r) for r in mixing.mixed_in(docs, block_docs=16).select("doc_id", "mix_epoch", "mix_block").collect())
    found = mixing.exponent(mixing.shares(mixing.counted(docs)), 0.95, 4.0, 1.0)
    want = []
    for source in {r[2] for r in rows}:
        own = [(d, len(t.split())) for d, t, s in rows if s == source]
        tokens_ = sum(n for _, n in own)
        if not tokens_:
            continue
        quota = (tokens_ / found["total"]) ** found["power"] / found["z"] * found["budget"]
        whole = math.floor(quota / tokens_ + 1e-9)
        rest, n_blocks = quota - whole * tokens_, -(-len(own) // 16)
        rest = rest if rest >= 0.5 else 0.0
        block = {d: signed(spark_hash((7,), "block", d)) % n_blocks for d, _ in own}
        order = sorted(set(block.values()), key=lambda b: (signed(spark_hash((7,), "order", source, b)), b))
        start = 0
        for nth, b in enumerate(order):
            members = sorted((signed(spark_hash((7,), d)), d, n) for d, n in own if block[d] == b)
            size = sum(n for _, _, n in members)
            inside = 0
            for _, d, n in members:
                extra = start + size <= rest or (start < rest and inside < rest - start)
                inside += n
                want += [(d, e, nth) for e in range(whole + bool(extra))]
            start += size
    assert got == sorted(want)


def test_examples_packed_within_three_limits(spark):
    """Conversations as examples: the assistant's turns bear loss. All limits bind somewhere, little is left over."""
    own = tokens.tokenizer(queries.vocabulary())[0]
    turns = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    rows = []
    for conv, g in turns.groupby("conv_id"):
        n = [len(own.encode(t or "", add_special_tokens=False).ids) + 1 for t in g["text"]]
        rows.append((int(conv), sum(n), sum(k for k, r in zip(n, g["role"]) if r == "assistant")))
    rows += [(10_000 + i, 12, 2) for i in range(300)] + [(20_000, 0, 0), (20_001, 5000, 10), (20_002, None, None)]
    limits = packing.Limits(tokens=2048, segments=16, loss=900)
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss long").coalesce(1), limits).toPandas()
    assert sorted(got["example_id"]) == sorted(r[0] for r in rows)
    placed = got[got["sequence_id"].notna()]
    assert set(got["example_id"]) - set(placed["example_id"]) == {20_000, 20_002}
    sums = placed.groupby("sequence_id").agg(tokens=("tokens", "sum"), loss=("loss", "sum"), n=("example_id", "count"))
    wide = sums["n"] > 1
    assert (sums["tokens"][wide] <= 2048).all() and (sums["loss"][wide] <= 900).all() and (sums["n"] <= 16).all()
    for _, g in placed.sort_values("segment").groupby("sequence_id"):
        assert g["segment"].tolist() == list(range(len(g))) and g["offset"].tolist() == (g["tokens"].cumsum() - g["tokens"]).tolist()
    full = (sums["tokens"] > 1900) | (sums["loss"] > 850) | (sums["n"] == 16)
    assert (sums["n"] == 16).any() and (sums["loss"] > 850).any() and full.mean() > 0.7


def test_packing_whole_documents(spark):
    own = tokens.tokenizer(queries.vocabulary())[0]
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op6_packing(spark, SF).toPandas()
    for doc, g in got.sort_values("start").groupby("doc_id"):
        ids = np.array(own.encode(text[doc] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (g["doc_tokens"] == len(ids)).all() and g["start"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() == len(ids)
        assert g["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n]) for a, n in zip(g["start"], g["length"])]
    sums = got.groupby("sequence_id")["length"].sum()
    assert set(got["doc_id"]) == set(text) and (sums <= 1024).all()
    padded = np.where((sums & (sums - 1)) == 0, sums, 1024)
    assert padded.sum() <= 1.02 * sums.sum()


def test_store_whole_documents(spark):
    own = tokens.tokenizer(queries.vocabulary())[0]
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got, at = {r["doc_id"]: r for r in queries.op8_token_output(spark, SF).collect()}, 0
    for doc, text in docs:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)


def test_store_of_nothing_and_of_rows_without_ids(spark):
    to = new_path(spark, "test")
    idstore.write_store(spark.createDataFrame([], DOCS), to, queries.vocabulary())
    assert idstore.read_digests(spark, to).count() == 0 and idstore.verify(spark, to)
    to = new_path(spark, "test")
    idstore.write_store(spark.createDataFrame([(None, "a", "s"), (None, None, "s"), (1, "a", None)], DOCS), to, queries.vocabulary())
    got = idstore.read_digests(spark, to).collect()
    assert sorted((r["doc_id"] is not None, r["n_tokens"]) for r in got) == [(False, 1), (False, 2), (True, 2)]


def test_vectors_whole(spark):
    """Links and components of every vector, with cells, blocks and shards that all overlap."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 24))
    x[200:600] = x[0] + 0.13 * rng.normal(size=(400, 24))  # cosines on both sides of the threshold
    x[600:700] = x[1] + 0.01 * rng.normal(size=(100, 24))  # one ball
    x[700:720] = x[2]
    rows = [(i, [float(v) for v in x[i]], -1 if i % 5 == 0 and i >= 720 else 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (y @ y.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    comp = np.arange(1500)
    while True:
        new = np.array([min(comp[i], comp[near[i]].min(initial=1500)) for i in range(1500)])
        if (new == comp).all():
            break
        comp = new
    for sizes in ({}, {"per_cell": 400, "block": 256}):
        got = vectors.near_vectors(df, **sizes).toPandas().sort_values("vec_id", ignore_index=True)
        assert got["n_links"].tolist() == near.sum(1).tolist()
        assert got["component_id"].tolist() == comp.tolist()
        assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_vectors_odd_rows(spark):
    a = [1.0, 0.0, 0.001]
    rows = [(None, a, 1), (6, a, 1), (7, a, 1), (7, a, 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.01], 1), (10, a, None), (11, None, 1), (None, [0.0, 1.0, 0.0], 1), (12, a, -1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as n", "'k' as cell")).collect()
    have = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in got)
    assert have == sorted([(-1, 3, 6, False), (6, 3, 6, True), (7, 3, 6, False), (7, 3, 6, False), (8, 1, 8, True), (9, 1, 8, False), (10, 0, 10, True), (11, 0, 11, True), (-1, 0, -1, True), (12, 0, 12, True)])
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_chats_of_any_turn_numbers(spark):
    """Turns 4095 and 4096 are one row; a beginning with other numbers goes; columns of other names don't matter."""
    rows = [(1, 4095, "user", "a"), (1, 4096, "assistant", "b"), (2, 0, "user", "a"), (3, 5000, "user", "c"), (3, None, "user", "d"), (4, 1, "user", "a"), (4, 9000, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as n", "'x' as x", "3 as block")
    got = {r["conv_id"]: (r["segment"], r["n_turns"], r["n_copies"], r["text"]) for r in chats.render(df).collect()}
    line = lambda r, t: f"<|{r}|>\n{t}\n<|end|>"
    assert got == {1: (0, 2, 2, line("user", "a") + "\n" + line("assistant", "b")), 3: (0, 2, 1, line("user", "d") + "\n" + line("user", "c"))}
