"""The stored index of terms: batches, replacements and removals equal an index made anew, and queries read their terms alone."""

import random

import pytest
from pyspark.sql import functions as F

from lodefield.functions.text import tokenize
from lodefield.operators import passages, postings, retrieval
from lodefield.operators.lineage import new_path

WORDS = "walk walked walking bought buy red the 7up naïve 漢字 bikes bike go went x-ray Ähre".split()
QUERY = "Where did she buy the walking bikes and went to 7up naïve"


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near(a, b):
    a, b = ({r[0]: r[1] for r in x.where("score > 0").collect()} for x in (a, b))
    assert a.keys() == b.keys() and a and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.fixture(scope="module")
def built(spark):
    """Three batches, in which documents are replaced and one is taken back, the second written twice; and what is live."""
    path, first, second = new_path(spark, "index"), texts(1, range(60)), texts(2, range(40, 90))
    postings.add(frame(spark, first), path, 0)
    postings.add(frame(spark, second), path, 1)
    postings.add(frame(spark, second), path, 1)
    postings.retire(frame(spark, [(3, None), (50, None), (5000, None)]), path, 2)
    postings.add(frame(spark, texts(3, [50])), path, 3)
    return path, frame(spark, sorted((dict(first) | dict(second) | dict(texts(3, [50]))).items())).where("doc_id <> 3")


def test_equal_to_anew(spark, built):
    path, docs = built
    assert postings.counts(spark, path) == (docs.count(), docs.agg(F.sum(F.size(tokenize(F.col("text"))))).first()[0])
    near(postings.bm25(spark, path, QUERY), retrieval.bm25(docs, QUERY))
    near(postings.lexical(spark, path, QUERY), retrieval.lexical(docs, QUERY))
    want = {r[0] for r in retrieval.candidates(docs, ["walk", "x"], ["naive"]).select("doc_id").collect()}
    assert {r[0] for r in postings.candidates(spark, path, ["walk", "x"], ["naive"]).collect()} == want
    tokens = docs.select("doc_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count(F.lit(1)).alias("tf"))
    assert sorted(map(tuple, postings.term_stats(spark, path).collect())) == sorted(map(tuple, tokens.collect()))


def test_compacted(spark, built):
    path, docs = built
    to = new_path(spark, "index")
    postings.compacted(spark, path, to)
    assert postings.counts(spark, to) == postings.counts(spark, path)
    near(postings.bm25(spark, to, QUERY), retrieval.bm25(docs, QUERY))
    postings.add(frame(spark, texts(9, range(5))), to, 1)
    assert postings.counts(spark, to)[0] == docs.count() + 1  # 3 is back


def test_reads_its_terms_only(spark, built):
    """The scan is of folders of the terms' heads, and is told the bounds of the terms."""
    path, _ = built
    own = postings.of_terms(spark, path, ["walk"], ["went"])
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(in_batch" in plan or "head" in plan.split("PartitionFilters:", 1)[1][:120]
    assert "StringStartsWith(term,walk)" in plan and {r[0] for r in own.select("head").distinct().collect()} == {"h_w"}
    assert {r[0] for r in own.select("term").distinct().collect()} == {"walk", "walked", "walking", "went"}
    other = postings.of_terms(spark, path, ["漢"], [])
    assert {r[0] for r in other.select("term").distinct().collect()} == {"漢"}


def test_no_terms(spark, built):
    path, docs = built
    assert postings.bm25(spark, path, "").count() == 0 and postings.lexical(spark, path, "!?").count() == 0
    empty = new_path(spark, "index")
    postings.add(docs.limit(0), empty, 0)
    assert postings.counts(spark, empty) == (0, 0) and postings.bm25(spark, empty, QUERY).count() == 0


def test_passages(spark):
    """Scores of sessions, rounds and turns from an index of turns, a conversation that has grown coming again."""
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), line()) for c in range(20) for t in range(rng.randint(1, 6))]
    more = [(c, t, "user", line()) for c in (2, 30) for t in range(7)]
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = new_path(spark, "index")
    postings.add_turns(make(turns), path, 0)
    postings.retire(make([r for r in turns if r[0] == 2]), path, 1, ("conv_id", "turn"))
    postings.add_turns(make(more), path, 2)
    want = passages.scores(make([r for r in turns if r[0] != 2] + more), QUERY).collect()
    got = postings.passage_scores(spark, path, QUERY).collect()
    assert {r[0]: [round(x, 9) for x in r[1:]] for r in got} == {r[0]: [round(x, 9) for x in r[1:]] for r in want}


def test_ranges_follow_the_tokens(spark, monkeypatch):
    """A range has so many tokens whatever their number, and none is joined with others to one that is sorted on disk."""
    rows = spark.createDataFrame([(i, f"t{i % 50}", 1) for i in range(1000)], "doc_id long, term string, tf int")
    monkeypatch.setattr(postings, "MOST_SORTED", 100)
    own = postings.sorted_(rows, ("doc_id",), 1000)
    sizes = [r["count"] for r in own.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 200 and sum(sizes) == 1000
