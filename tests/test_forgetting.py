"""The three ways to forget, against a walk over a small store."""

import hashlib
import random

import pytest

from lodefield.operators import forgetting

E = "tenant string, branch string, cid string, user_id string, content string, erased boolean, embedding array<float>, sources array<string>"
C = "tenant string, branch string, id long, subject string, predicate string, object string, status string, sources array<string>, conjunctive boolean"
R = "tenant string, branch string, id long, source string, predicate string, target string, valid_to timestamp, sources array<string>"


def stores(seed):
    rng = random.Random(seed)
    some = lambda top, most: [f"c{rng.randint(0, top)}" for _ in range(rng.randint(0, most))]
    evidence = [("t", "main", f"c{i}", rng.choice(["u", None]), f"text {i}", i == 17, [0.5], some(i - 1, 2) if i > 3 and rng.random() < 0.8 else None) for i in range(30)]
    evidence += [("t", "other", "c1", "u", "elsewhere", False, [0.5], ["c0"]), ("x", "main", "c1", "u", "theirs", False, [0.5], None)]
    claims = [("t", "main", i, f"s{i % 4}", "p", "o", rng.choice(["active", "contested"]), some(29, 3), rng.choice([True, False, None])) for i in range(40)]
    claims.append(("t", "other", 99, "s", "p", "o", "active", ["c1"], False))
    relations = [("t", "main", i, c[3], "p", "o", None, c[7] if i % 2 else some(29, 2)) for i, c in enumerate(claims[:30])]
    return evidence, claims, relations


def walk(evidence, claims, relations, roots, mode):
    live = {e[2]: e for e in evidence if e[:2] == ("t", "main")}
    gone = {c for c in roots if c in live}
    while True:
        new = set()
        for cid, e in live.items():
            s = set(e[7] or []) - {cid}
            if cid not in gone and not e[5] and s & gone and (mode == "legal" or s <= gone):
                new.add(cid)
        if not new:
            break
        gone |= new
    if mode == "hard":
        blocks = {c[2] for c in claims if c[:2] == ("t", "main") and c[6] == "active" and c[7] and set(c[7]) <= gone and len(set(c[7])) < 2}
        if blocks:
            return evidence, claims, relations, {("claims", str(i), "blocks") for i in blocks}
    notes, out_e, out_c, out_r, fallen = set(), [], [], [], set()
    for e in evidence:
        here = e[:2] == ("t", "main")
        if here and e[2] in gone:
            notes.add(("evidence", e[2], "erased" if mode == "tombstone" else "removed"))
            if mode == "tombstone":
                out_e.append((*e[:4], "", True, None, e[7] or []))
        elif here and not e[5] and set(e[7] or []) & gone:
            notes.add(("evidence", e[2], "trimmed"))
            out_e.append((*e[:7], [s for s in e[7] if s not in gone]))
        else:
            out_e.append((*e[:7], (e[7] or []) if here else e[7]))
    for c in claims:
        if c[:2] == ("t", "main") and set(c[7]) & gone:
            left = [s for s in c[7] if s not in gone]
            if not left or c[8]:
                notes.add(("claims", str(c[2]), "retracted"))
                out_c.append((*c[:3], "[erased]", "erased", "[erased]", "retracted", [], c[8]))
                if c[8]:
                    fallen.add((c[3], c[4], c[5], frozenset(c[7])))
            else:
                notes.add(("claims", str(c[2]), "trimmed"))
                out_c.append((*c[:7], left, c[8]))
        else:
            out_c.append(c)
    for r in relations:
        if set(r[7]) & gone:
            left = [s for s in r[7] if s not in gone]
            if not left or (*r[3:6], frozenset(r[7])) in fallen:
                notes.add(("relations", str(r[2]), "expired"))
                out_r.append((*r[:3], "[erased]", "erased", "[erased]", "ended", []))
            else:
                notes.add(("relations", str(r[2]), "trimmed"))
                out_r.append((*r[:7], left))
        else:
            out_r.append(r)
    return out_e, out_c, out_r, notes


@pytest.mark.parametrize("seed,mode,roots", [(1, "tombstone", ["c1", "c2", "zz"]), (2, "legal", ["c0", "c3"]), (1, "hard", ["c1"]), (5, "hard", ["c29"]), (3, "tombstone", [])])
def test_against_a_walk(spark, seed, mode, roots):
    evidence, claims, relations = stores(seed)
    got = forgetting.forget(spark.createDataFrame(evidence, E), spark.createDataFrame(claims, C), spark.createDataFrame(relations, R), spark.createDataFrame([(r,) for r in roots], "cid string"), mode)
    e, c, r, notes = walk(evidence, claims, relations, roots, mode)
    show = lambda rows: sorted((tuple("ended" if hasattr(v, "year") else tuple(v) if isinstance(v, list) else v for v in x) for x in rows), key=str)
    assert show(got.evidence.collect()) == show(e)
    assert show(got.claims.collect()) == show(c)
    assert show(got.relations.collect()) == show(r)
    receipt = got.receipt.collect()
    assert {tuple(x)[:3] for x in receipt} == notes and len(receipt) == len(notes)
    texts = {x[2]: x for x in evidence if x[:2] == ("t", "main")}
    for x in receipt:
        if x["action"] in ("erased", "removed"):
            own = texts[x["id"]]
            assert x["digest"] == hashlib.sha256("\x1f".join(("forgotten-evidence:v1", "t", own[3] or "", own[4])).encode()).hexdigest()


def test_modes(spark):
    with pytest.raises(ValueError):
        forgetting.forget(None, None, None, None, "gently")
