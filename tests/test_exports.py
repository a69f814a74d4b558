"""What leaves a store: nothing that derives from a denied row, and no field that a policy names."""

import random

from pyspark.sql import functions as F

from lodefield.operators import exports

SCHEMA = "cid string, sources array<string>, reason string, allowed boolean"


def test_chains(spark):
    rng = random.Random(2)
    for _ in range(3):
        rows = []
        for i in range(60):
            ok = rng.random() < 0.9
            of = [f"c{rng.randint(0, max(0, i - 1))}" for _ in range(rng.randint(0, 2))] if i else []
            if rng.random() < 0.05:
                of.append("gone")
            rows.append((f"c{i}", of or None, "allowed" if ok else "restricted", ok))
        rows += [("x", ["y"], "allowed", True), ("y", ["x"], "allowed", True), ("z", ["z", "c0"], "allowed", True)]
        of = {c: s or [] for c, s, *_ in rows}
        own = {c: ok for c, _, _, ok in rows}

        def above(c):
            seen, todo = set(), list(of[c])
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen.add(at)
                    todo += of.get(at, [])
            return seen

        want = {}
        for c, _, reason, ok in rows:
            up = above(c)
            want[c] = reason if not ok else "source_missing" if up - own.keys() else "source_denied" if any(not own[u] for u in up) else "allowed"
        got = {r["cid"]: (r["reason"], r["allowed"]) for r in exports.closed(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {c: (r, r == "allowed") for c, r in want.items()}


def test_claims_go_with_their_sources(spark):
    evidence = spark.createDataFrame([("a", True), ("b", False)], "cid string, allowed boolean")
    rows = [(1, ["a"], "allowed", True), (2, ["a", "b"], "allowed", True), (3, ["a", "q"], "allowed", True), (4, None, "allowed", True), (5, ["a"], "restricted", False)]
    got = exports.with_sources(spark.createDataFrame(rows, "id long, sources array<string>, reason string, allowed boolean"), evidence)
    assert {r["id"]: r["reason"] for r in got.collect()} == {1: "allowed", 2: "source_denied", 3: "source_missing", 4: "allowed", 5: "restricted"}
    counts = exports.disclosed(got.withColumn("redacted", F.col("id") == 1), "claims")
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"redacted": 1, "whole": 1, "source_denied": 1, "source_missing": 1, "restricted": 1}


def test_nested_fields(spark):
    kind = "id long, name string, age int, person struct<Name:string, address:struct<street:string, no:int>>, many array<struct<name:string, x:int>>, extra map<string, string>, content string, redact_fields array<string>, redacted boolean"
    person = ("Ann", ("High St", 5))
    rows = [
        (1, "Ann", 30, person, [("Bob", 1), (None, 2)], {"NAME": "c", "k": "v"}, "name: Ann, note: x", ["name"], True),
        (2, "Ann", 30, person, [("Bob", 1)], None, "nothing", ["STREET", "no", "age"], True),
        (3, "Ann", 30, None, None, {"k": "v"}, None, ["name"], True),
        (4, "Ann", 30, person, [], {"name": "c"}, "name: Ann", ["name"], False),
        (5, "Ann", 30, person, [], {}, "name: Ann", None, True),
    ]
    df = spark.createDataFrame(rows, kind)
    out = exports.redacted(df, keep=("id",), texts=("content",))
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r["id"]: r for r in out.collect()}
    r = got[1]
    assert (r["name"], r["age"], r["person"]["Name"], r["person"]["address"]["street"]) == ("[REDACTED:name]", 30, "[REDACTED:Name]", "High St")
    assert [x["name"] for x in r["many"]] == ["[REDACTED:name]", None] and r["extra"] == {"NAME": "[REDACTED:NAME]", "k": "v"} and r["content"] == "name: [REDACTED:name], note: x"
    r = got[2]
    assert (r["name"], r["age"], r["person"]["address"]["street"], r["person"]["address"]["no"], r["content"]) == ("Ann", None, "[REDACTED:street]", None, "[REDACTED]")
    assert (got[3]["person"], got[3]["many"], got[3]["content"]) == (None, None, None)
    assert got[4].asDict(True) == df.where("id = 4").first().asDict(True)
    assert got[5]["content"] == "[REDACTED]" and got[5]["name"] == "Ann"


def test_statements(spark):
    own = spark.createDataFrame([(1, ["object"], True), (2, ["lives in"], True), (3, ["phone"], True), (4, ["object"], False)], "id long, f array<string>, r boolean")
    said = exports.statement(F.lit("Ann"), F.lit("lives in:"), F.lit("Rome"), F.col("f"), F.col("r"))
    assert {r["id"]: r["s"] for r in own.select("id", said.alias("s")).collect()} == {1: "Ann lives in: [REDACTED:object]", 2: "Ann lives in: [REDACTED:lives in]", 3: "[REDACTED]", 4: "Ann lives in: Rome"}


def test_names_without_fields(spark):
    df = spark.createDataFrame([(1, "secret", 5, ["phone"], True)], "id long, a string, n int, redact_fields array<string>, redacted boolean")
    r = exports.redacted(df, keep=("id",)).first()
    assert (r["a"], r["n"]) == ("[REDACTED]", 5)


def test_policies_merge(spark):
    """Permits are intersected over the policies that name any, break-glass needs all, a hold or a conflict restricts."""
    from lodefield.operators import access

    schema = "k string, tenant string, restricted boolean, max_sensitivity int, expires_at date, min_role_for_raw string, embed_ok boolean, data_class string, allow_roles array<string>, purposes array<string>, require_capabilities array<string>, redact_fields array<string>, allow_principals array<string>, residency array<string>, lawful_basis array<string>, break_glass boolean, hold string"
    row = lambda k, tenant="t", principals=(), residency=(), basis=(), glass=None, hold=None: (k, tenant, False, None, None, None, True, None, [], [], [], [], list(principals), list(residency), list(basis), glass, hold)
    rows = [row("a", principals="xy", residency=["eu"], glass=True), row("a", principals="yz", glass=True), row("b", basis=["consent"], glass=True), row("b", basis=["contract"]), row("c", hold="court"), row("c"), row("d", tenant="t"), row("d", tenant="u")]
    got = {r["k"]: r for r in access.merged_policies(spark.createDataFrame(rows, schema), "k").collect()}
    assert (got["a"]["allow_principals"], got["a"]["residency"], got["a"]["break_glass"], got["a"]["restricted"]) == (["y"], ["eu"], True, False)
    assert (got["b"]["lawful_basis"], got["b"]["break_glass"]) == ([], False)
    assert (got["c"]["hold"], got["c"]["restricted"]) == ("court", True)
    assert (got["d"]["hold"], got["d"]["restricted"]) == ("tenant-conflict", True)
