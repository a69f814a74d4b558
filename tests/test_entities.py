"""Merges of names from a log, against a walk over it; what is taken back leaves the state before."""

import random

from pyspark.sql import functions as F

from lodefield.operators import entities


def walk(log):
    undone = {(t, u) for t, _, kind, _, _, u in log if kind == "undo"}
    apart = {(t, frozenset((a, b))) for t, _, kind, a, b, _ in log if kind == "distinct"}
    cluster, results = {}, {}
    for t, seq, kind, a, b, _ in sorted(log, key=lambda r: (r[1], r[3] or "", r[4] or "")):
        if kind != "merge":
            continue
        if (t, seq) in undone:
            results[t, seq] = "undone"
            continue
        x, y = cluster.setdefault((t, a), {a}), cluster.setdefault((t, b), {b})
        if x is not y:
            numbers = {frozenset(w for w in k.split("-") if w.isdigit()) for k in x | y} - {frozenset()}
            if len(numbers) > 1 or any((t, frozenset((p, q))) in apart for p in x for q in y):
                results[t, seq] = "vetoed"
                continue
            x |= y
            for k in y:
                cluster[t, k] = x
        results[t, seq] = "applied"
    return {k: min(c) for k, c in cluster.items()}, results


def test_replay(spark):
    rng = random.Random(6)
    for n in range(3):
        names = [f"k{i}" for i in range(14)] + ["x-1", "x-2", "x"]
        log = [(rng.choice("ab"), i, "merge", *rng.sample(names, 2), None) for i in range(25)]
        log += [(rng.choice("ab"), 100 + i, "distinct", *rng.sample(names, 2), None) for i in range(6)]
        log += [(rng.choice("ab"), 200 + i, "undo", None, None, rng.randint(0, 30)) for i in range(5 * n)]
        keys, results = entities.replayed(spark.createDataFrame(log, entities.LOG))
        want, what = walk(log)
        assert {(r["tenant"], r["key"]): r["entity"] for r in keys.collect()} == want
        assert {(r["tenant"], r["seq"]): r["result"] for r in results.collect()} == what


def test_taken_back(spark):
    """A merge and its undo give the state before the merge, whatever came after it."""
    log = [("t", 1, "merge", "ann", "anna", None), ("t", 2, "merge", "anna", "anne", None), ("t", 3, "merge", "bob", "rob", None)]
    state = lambda rows: {(r["name"], r["entity"]) for r in entities.resolved(mentions, spark.createDataFrame(rows, entities.LOG)).collect()}
    mentions = spark.createDataFrame([("t", n) for n in ("Ann", "Anna!", "anne", "Bob", "ROB", "--", None)], "tenant string, name string")
    before = state([log[0], log[2]])
    assert state(log) == {("Ann", "ann"), ("Anna!", "ann"), ("anne", "ann"), ("Bob", "bob"), ("ROB", "bob"), ("--", None), (None, None)}
    assert state([*log, ("t", 9, "undo", None, None, 2)]) == before
    got = entities.entities(entities.resolved(mentions, spark.createDataFrame(log, entities.LOG)))
    assert {(r["entity"], tuple(r["aliases"]), r["mentions"]) for r in got.collect()} == {("ann", ("ann", "anna", "anne"), 3), ("bob", ("bob", "rob"), 2)}


def test_candidates(spark):
    names = ["jane doe", "Doe, Jane", "jane doee", "jane d", "route 66 diner", "route 67 diner", "grönwald", "gronwald", "ab", "ba"]
    keys = spark.createDataFrame([("t", n) for n in names] + [("u", "doe jane"), ("t", None)], "tenant string, name string").select("tenant", entities.key(F.col("name")).alias("key"))
    got = {(r["left_key"], r["right_key"]): r["score"] for r in entities.candidates(keys).collect()}
    assert got == {("doe-jane", "jane-doe"): 1.0, ("jane-doe", "jane-doee"): 0.9, ("gronwald", "grönwald"): 0.9}
    many = spark.createDataFrame([("t", f"common-{'x' * 6}{chr(97 + i)}") for i in range(26)], "tenant string, key string")
    assert entities.candidates(many).count() == 25  # not the square
