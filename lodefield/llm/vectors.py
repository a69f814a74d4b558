"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

    1. Equal vectors of a label become one node. A label of more nodes than a cell holds is dealt to cells around centres
       fitted on a bounded sample; each node goes to its nearest cells, the nearest being its home.
    2. A cell's nodes are dealt to overlapping shards, two for each node. Each shard builds a graph: a node's nearest and a
       few random ones, pruned as in DiskANN's RobustPrune, and what points back. The shards' adjacency lists are united.
    3. Nodes within half the threshold's angle of one of them are a ball: its members all link with each other.
    4. Each ball searches the united graph once: greedily from the shards' medoids, then from all it found in range
       outwards along edges, the range widened by the ball's own radius. What it comes to is held against all members.
       A link counts in the home cell of the node that is found, so that counts add up over cells.
    5. Links are those whose cosine, in double precision, reaches the threshold. Recall is audited against brute force
       on a bounded set of queries; if it is too low, all is done again with twice the cells for each node, and it is an
       error if it stays too low.

A cell of more than `block` nodes, as around a very common vector, is dealt into blocks of nodes and of queries; each
task has one of either, and counts add up over blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, cut, drop, ready

DEGREE, ALPHA, BEAM, NEAR, RANDOM, SHARD = 24, 1.2, 24, 32, 8, 500


def unit(column) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, k: int, most: int = 2048, rounds: int = 6) -> np.ndarray:
    """k directions around which the rows of x lie, fitted on `most` of them."""
    rng = np.random.default_rng(len(x))
    own = x[rng.choice(len(x), most, replace=False)] if len(x) > most else x
    c = own[rng.choice(len(own), min(k, len(own)), replace=False)]
    for _ in range(rounds):
        at = (own @ c.T).argmax(1)
        for j in range(len(c)):
            if (at == j).any():
                m = own[at == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def pruned(x: np.ndarray) -> np.ndarray:
    """Edges (i, j) of the graph of rows x: of each row's nearest and some random ones, nearest first, those that no kept one
    is ALPHA times nearer to than the row is (distance is 1 - cosine), DEGREE at most, and the nearest always."""
    n = len(x)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    near, sims = min(n - 1, NEAR), x @ x.T
    np.fill_diagonal(sims, -2.0)
    top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    cand = np.concatenate((top, np.random.default_rng(n).integers(0, n, (n, RANDOM))), 1)
    rows = np.arange(n)[:, None]
    cand = np.take_along_axis(cand, np.argsort(-sims[rows, cand], axis=1, kind="stable"), 1)
    far = 1 - sims[rows, cand]
    alive, kept = cand != rows, np.zeros(cand.shape, bool)
    for t in range(cand.shape[1]):
        kept[:, t] = alive[:, t] & (kept.sum(1) < DEGREE)
        i = np.flatnonzero(kept[:, t])
        if len(i) and t + 1 < cand.shape[1]:
            alive[i, t + 1 :] &= ALPHA * (1 - sims[cand[i, t][:, None], cand[i, t + 1 :]]) > far[i, t + 1 :]
    i, t = np.nonzero(kept)
    return np.stack((i, cand[i, t]), 1)


def united(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The graph of rows x as (first, neighbours): row i's are neighbours[first[i] : first[i + 1]]; and the shards' medoids.
    Shards are built one by one, each row being in two of them, and their edges united, both ways."""
    n = len(x)
    k = max(1, -(-n // SHARD))
    if k == 1:
        parts = [np.arange(n)]
    else:
        at = np.argsort(-(x @ centres(x, k).T), axis=1, kind="stable")[:, :2]
        parts = [np.flatnonzero((at == j).any(1)) for j in range(k)]
    edges, medoids = [], []
    for own in parts:
        if len(own):
            for lo in range(0, len(own), 4 * SHARD):  # a shard can't outgrow its bound however rows lie
                some = own[lo : lo + 4 * SHARD + SHARD]
                edges.append(some[pruned(x[some])])
                medoids.append(some[int((x[some] @ x[some].mean(0)).argmax())])
    e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    codes = np.unique(np.concatenate((e[:, 0] * n + e[:, 1], e[:, 1] * n + e[:, 0])))
    # Shards are tied through their medoids, however few rows they have in common.
    m = np.unique(np.array(medoids, np.int64)) if medoids else np.zeros(0, np.int64)
    if len(m) > 1:
        codes = np.unique(np.concatenate((codes, m[:-1] * n + m[1:], m[1:] * n + m[:-1])))
    first = np.searchsorted(codes, np.arange(n + 1) * n)
    return first, codes % max(n, 1), m


def balls(x: np.ndarray, first: np.ndarray, nbr: np.ndarray, reach: float) -> np.ndarray:
    """For each row the row whose ball it is in: no further than the angle of cosine `reach` from it, along edges."""
    of = np.full(len(x), -1)
    src = np.repeat(np.arange(len(x)), np.diff(first))
    near = np.zeros(len(x), bool)
    for lo in range(0, len(nbr), 1 << 18):
        a, b = src[lo : lo + (1 << 18)], nbr[lo : lo + (1 << 18)]
        near[a[np.einsum("ij,ij->i", x[a], x[b]) >= reach]] = True
    for i in np.flatnonzero(near).tolist():
        if of[i] >= 0:
            continue
        of[i], now = i, np.array([i])
        while len(now):
            new = np.unique(np.concatenate([nbr[first[k] : first[k + 1]] for k in now]))
            new = new[of[new] < 0]
            now = new[x[new] @ x[i] >= reach]
            of[now] = i
    return np.where(of < 0, np.arange(len(x)), of)


def search(x: np.ndarray, first: np.ndarray, nbr: np.ndarray, medoids: np.ndarray, q: np.ndarray, reach: float, slack: float = 0.02) -> np.ndarray:
    """The rows of cosine `reach` or more with q that a beam from the medoids, and then an expanding range, come to."""
    seen = np.zeros(len(x), bool)
    ids, sims, done = medoids, x[medoids] @ q, np.zeros(len(medoids), bool)
    seen[ids] = True
    while True:
        order = np.argsort(-sims, kind="stable")[:BEAM]
        ids, sims, done = ids[order], sims[order], done[order]
        go = np.flatnonzero(~done)[:4]
        if not len(go):
            break
        done[go] = True
        new = np.concatenate([nbr[first[i] : first[i + 1]] for i in ids[go]])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        ids, sims, done = np.concatenate((ids, new)), np.concatenate((sims, x[new] @ q)), np.concatenate((done, np.zeros(len(new), bool)))
    now = ids[sims >= reach - slack]
    if not len(now):
        return now
    seen[:] = False
    seen[now] = True
    found = [now[x[now] @ q >= reach]]
    while len(now):
        new = np.concatenate([nbr[first[i] : first[i + 1]] for i in now])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        s = x[new] @ q
        found.append(new[s >= reach])
        now = new[s >= reach - slack]
    return np.concatenate(found)


def _centres(nodes: DataFrame, sample: int, per_cell: int) -> dict[int, np.ndarray]:
    """Centres of the cells of each label that one cell can't hold. They are fitted on `sample` nodes altogether; where four
    for each centre are more than that, these nodes give a label some first centres only, and the nodes nearest to each of
    them, four for each centre, are fitted by a task of their own: the driver has the sample and the centres."""
    sizes = {r["label"]: r["count"] for r in nodes.groupBy("label").count().where(F.col("count") > per_cell).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    own = nodes.where(F.col("label").isin(list(sizes))) if len(sizes) < 1000 else nodes
    part = lambda n: own.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < int(min(1.0, n / total) * (1 << 30)) + 1)
    picked = part(sample).select("label", "w", "x").toPandas()
    wanted = {label: max(2, -(-n // per_cell)) for label, n in sizes.items()}
    two = 4 * total // per_cell > sample
    out = {}
    for label, k in wanted.items():
        some = picked[picked["label"] == label]
        if len(some):
            some = some[some["w"] == some["w"].mode()[0]]
            out[int(label)] = centres(unit(some["x"]), max(2, int(np.ceil(np.sqrt(k)))) if two else k, most=sample)
    if not two:
        return out
    first = nodes.sparkSession.sparkContext.broadcast(out)

    def near(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for (label, w), g in pdf.groupby(["label", "w"]):
                c = first.value.get(label)
                if c is not None and c.shape[1] == w:
                    yield pa.RecordBatch.from_pandas(g.assign(top=(unit(g["x"]) @ c.T).argmax(1))[["label", "top", "x"]], preserve_index=False)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        found = centres(unit(pdf["x"]), max(1, round(len(pdf) / 4)), most=sample)
        return pd.DataFrame({"label": label, "x": list(found)})

    dealt = part(4 * total // per_cell).select("label", "w", "x").mapInArrow(near, "label long, top long, x array<double>")
    got = dealt.groupBy("label", "top").applyInPandas(lambda pdf: fitted(pdf), "label long, x array<double>").toArrow()
    flat, labels = np.asarray(got.column("x").combine_chunks().flatten()), np.asarray(got.column("label").combine_chunks())
    starts = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(got.column("x").combine_chunks())))))
    for label in out:
        mine = np.flatnonzero(labels == label)
        if len(mine):
            out[label] = np.stack([flat[starts[i] : starts[i + 1]] for i in mine])
    return out


def witnesses(nodes: DataFrame, threshold: float, most: int = 200_000, bands: int = 12, bits: int = 16) -> DataFrame:
    """(node): ends of links that are found without the graph. Nodes of equal signs of `bits` random projections lie in one
    bucket, once for each band; as many whole buckets are drawn as hold `most` nodes, and in the order of one more
    projection neighbours are compared. Buckets are dealt by range, so that none is one task's."""
    n = nodes.count()
    share = min(1.0, most / max(1, n * bands))

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for w, g in pdf.groupby("w"):
                x = unit(g["x"])
                for band in range(bands):
                    planes = np.random.default_rng([band, int(w)]).standard_normal((int(w), bits + 1))
                    at = x @ planes
                    key = (at[:, :bits] > 0) @ (1 << np.arange(bits))
                    draw = np.random.default_rng([7, band]).random(1 << bits)[key] < share
                    if draw.any():
                        yield pa.RecordBatch.from_pandas(g[draw].assign(band=band, key=key[draw], at=at[draw, bits])[["label", "w", "band", "key", "at", "node", "x"]], preserve_index=False)

    def compared(batches):
        last = None
        for batch in batches:
            pdf = batch.to_pandas()
            if last is not None:
                pdf = pd.concat((last, pdf), ignore_index=True)
            last = pdf.tail(1)
            if len(pdf) < 2:
                continue
            a, b = pdf.iloc[:-1], pdf.iloc[1:]
            alike = (a[["label", "w", "band", "key"]].to_numpy() == b[["label", "w", "band", "key"]].to_numpy()).all(1)
            at = np.flatnonzero(alike)
            if len(at):
                x, y = unit(a["x"].iloc[at]), unit(b["x"].iloc[at])
                at = at[np.einsum("ij,ij->i", x, y) >= threshold]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a["node"].to_numpy()[at], b["node"].to_numpy()[at])))], names=["node"])

    dealt = nodes.select("label", "w", "node", "x").mapInArrow(run, "label long, w int, band long, key long, at double, node long, x array<double>")
    order = ["label", "w", "band", "key", "at", "node"]
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, "node long").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.98, overlap: int = 3, per_cell: int = 8192, block: int = 16_384, sample: int = 20_000, audit: int = 256, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector (vec_id, embedding, label); other columns are not read.

    Vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing.
    Vectors of different widths don't link. Repeated vec_ids are rows each, and link with each other if equal. Rows without
    a vec_id link as others do; they are kept only where no row they reach has one. No rows: no rows. Centres and audit
    are fitted on bounded samples, every row is indexed and searched.
    """
    ready(vectors.sparkSession)
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "cast(embedding as array<double>) x")
    fine = "label is not null and x is not null and not exists(x, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists(x, e -> e <> 0)"
    rows = rows.withColumn("ok", F.coalesce(F.expr(fine), F.lit(False))).withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "x"))).withColumn("w", F.size("x"))
    nodes = cut(rows.where("ok").groupBy("label", "node", "w").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")), "nodes")
    slim = cut(rows.select("vec_id", "node"), "vectors")
    while True:
        found = _linked(nodes, threshold, overlap, per_cell, block, sample)
        share = audited(nodes, found, threshold, audit)
        if share >= recall:
            break
        if overlap >= 24:
            raise RuntimeError(f"near_vectors: at {overlap} cells for each node the audit found {share:.4f} of the links, less than {recall}")
        drop(found)
        overlap *= 2
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.where("root <> node").select(F.least("root", "node").alias("a"), F.greatest("root", "node").alias("b")))
    own = nodes.select("node", "least", "n").join(sums, "node", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    own = cut(own.select("node", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "links")
    tops = own.groupBy("root").agg(F.min("least").alias("top"))
    own = own.join(tops, "root").select("node", "n_links", F.col("top").alias("component_id"))
    out = slim.join(own, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("vec_id") == component, component.isNull())
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def _linked(nodes: DataFrame, threshold: float, overlap: int, per_cell: int, block: int, sample: int) -> DataFrame:
    """(node, links, root) for each search: how many vectors it found, and the smallest node its links reach there."""
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast(_centres(nodes, sample, per_cell))
    half = float(np.cos(np.arccos(threshold) / 2 - 1e-9))

    def cells(batches):
        for batch in batches:
            label, node, n, x, w = batch.column("label"), batch.column("node"), batch.column("n"), batch.column("x"), np.asarray(batch.column("w"))
            every = {k: [] for k in ("row", "cell", "home")}
            labels = np.asarray(label)
            flat, off = np.asarray(x.flatten()), np.asarray(x.offsets) - x.offsets[0].as_py()
            for l, width in {*zip(labels.tolist(), w.tolist())}:
                at = np.flatnonzero((labels == l) & (w == width))
                c = sent.value.get(l)
                if c is None or c.shape[1] != width:
                    near = np.zeros((len(at), 1), np.int64)
                else:
                    v = np.stack([flat[off[i] : off[i] + width] for i in at])
                    near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :overlap]
                for k in range(near.shape[1]):
                    every["row"].append(at)
                    every["cell"].append(near[:, k])
                    every["home"].append(np.full(len(at), k == 0))
            if not every["row"]:
                continue
            row = pa.array(np.concatenate(every["row"]))
            yield pa.RecordBatch.from_arrays([label.take(row), pa.array(w).take(row), pa.array(np.concatenate(every["cell"])), pa.array(np.concatenate(every["home"])), node.take(row), n.take(row), x.take(row)], names=["label", "w", "cell", "home", "node", "n", "x"])

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each node's united list, its ball, and whether it is a medoid."""
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, x = pdf["node"].to_numpy(), unit(pdf["x"])
        first, nbr, medoids = united(x)
        pdf["near"] = [ids[nbr[first[i] : first[i + 1]]] for i in range(len(ids))]
        pdf["ball"], pdf["medoid"] = ids[balls(x, first, nbr, half)], np.isin(np.arange(len(ids)), medoids)
        return pdf[graph_columns]

    def searched(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: the block's nodes with their lists; right: the block's queries, ball by ball."""
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        left = left.sort_values("node", ignore_index=True)
        ids, x, home, n, ball = left["node"].to_numpy(), unit(left["x"]), left["home"].to_numpy(), left["n"].to_numpy(), left["ball"].to_numpy()
        near = left["near"].tolist()
        first = np.concatenate(([0], np.cumsum([len(v) for v in near])))
        nbr = np.searchsorted(ids, np.concatenate(near).astype(np.int64)) if first[-1] else np.zeros(0, np.int64)
        medoids, weight = np.flatnonzero(left["medoid"].to_numpy()), n * home
        right = right.sort_values(["q_ball", "q_node"], ignore_index=True)
        q_ids, q, q_ball = right["q_node"].to_numpy(), unit(right["q_x"]), right["q_ball"].to_numpy()
        links, edges = np.zeros(len(q_ids), np.int64), []
        starts = np.flatnonzero(np.concatenate(([True], q_ball[1:] != q_ball[:-1])))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(q_ids)]):
            m = q[lo:hi]
            at = lo + int(np.searchsorted(q_ids[lo:hi], q_ball[lo]))
            radius = np.arccos(np.clip((m @ q[at]).min(), -1, 1)) if hi - lo > 1 else 0.0
            got = search(x, first, nbr, medoids, q[at], float(np.cos(min(np.pi, np.arccos(threshold) + radius))))
            own = ball[got] == q_ball[lo]
            mine = np.searchsorted(ids, q_ids[lo:hi])
            mine = mine[(mine < len(ids))]
            mine = mine[np.isin(ids[mine], q_ids[lo:hi])]
            links[lo:hi] += int(weight[mine].sum())  # all members link with each other
            here = np.searchsorted(ids, q_ids[lo:hi])
            here_ok = (here < len(ids)) & (ids[np.minimum(here, len(ids) - 1)] == q_ids[lo:hi])
            links[lo:hi] -= np.where(here_ok, weight[np.minimum(here, len(ids) - 1)], 0)
            rest = got[~own]
            for a in range(0, hi - lo, 2048):
                if not len(rest):
                    break
                hit = m[a : a + 2048] @ x[rest].T >= threshold
                links[lo + a : min(hi, lo + a + 2048)] += hit @ weight[rest]
                edges += [(q_ball[lo], b) for b in np.unique(ball[rest[hit.any(0)]])]
        root = {}

        def top(i):
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        for a, b in edges:
            a, b = top(int(a)), top(int(b))
            if a != b:
                root[max(a, b)] = min(a, b)
        extra = [k for k in root if top(k) != k]
        return pd.DataFrame({"node": np.concatenate((q_ids, np.array(extra, np.int64))), "links": np.concatenate((links, np.zeros(len(extra), np.int64))), "root": np.concatenate((q_ball, np.array([top(k) for k in extra], np.int64)))})

    schema = "label long, w int, cell long, home boolean, node long, n long, x array<double>"
    dealt = nodes.select("label", "w", "node", "n", "x").mapInArrow(cells, schema)
    key = ["label", "w", "cell"]
    sizes = dealt.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = dealt.join(sizes, key).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    graph_columns = [*key, "home", "node", "n", "x", "blocks", "b", "near", "ball", "medoid"]
    whole = cut(dealt.groupBy(*key, "b").applyInPandas(lambda pdf: built(pdf), schema + ", blocks int, b int, near array<long>, ball long, medoid boolean"), "lists")
    left = whole.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "b", "qb", "node", "home", "n", "x", "near", "ball", "medoid")
    right = whole.withColumn("nb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*(F.col(k).alias(f"q_{k}") for k in key), F.col("nb").alias("q_b"), F.col("b").alias("q_qb"), F.col("node").alias("q_node"), F.col("x").alias("q_x"), F.col("ball").alias("q_ball"))
    by = [*key, "b", "qb"]
    out = cut(left.groupBy(*by).cogroup(right.groupBy(*(f"q_{k}" for k in by))).applyInPandas(searched, "node long, links long, root long"), "found")
    drop(whole)
    return out


def audited(nodes: DataFrame, found: DataFrame, threshold: float, queries: int, whole: int = 20_000) -> float:
    """The share of its links that a node finds, on average over the audited nodes that have any: against all nodes, in
    blocks. Nodes with links to over a hundredth of all vectors are averaged apart, and the smaller average counts.

    Of the queries a quarter are nodes for which few links were found, a quarter such with many, a quarter ends of links
    that were found without the graph, a quarter any nodes: links that are lost altogether show in the last two. If none of
    them has a link, all nodes are audited in a table of up to `whole`; in a larger one buckets of near signs hold no
    link then, and recall is 1 of nothing."""
    many = (nodes.agg(F.sum("n")).first()[0] or 0) // 100
    sums = found.groupBy("node").agg(F.sum("links").alias("seen"), F.min("root").alias("root"))
    drawn = lambda df, n: df.select("node").orderBy(F.xxhash64(F.lit(5), "node")).limit(n)
    some = drawn(sums.where(f"seen <= {many} and (seen > 0 or root <> node)"), queries // 4).union(drawn(sums.where(f"seen > {many}"), queries // 4))
    some = some.union(drawn(witnesses(nodes, threshold), queries // 4)).union(drawn(nodes, queries // 4))
    shares = _shares(nodes, found, threshold, nodes.join(F.broadcast(some.distinct()), "node", "left_semi"), many)
    if not shares and nodes.limit(whole + 1).count() <= whole:
        shares = _shares(nodes, found, threshold, nodes, many)
    return min(shares, default=1.0)


def _shares(nodes: DataFrame, found: DataFrame, threshold: float, asked: DataFrame, many: int) -> list[float]:
    """The average share of links found of asked nodes with few links, and with many, where there are any."""
    few = asked.select("label", "w", "node", "x").toPandas()
    if not len(few):
        return []
    sent = nodes.sparkSession.sparkContext.broadcast({k: (g["node"].to_numpy(), unit(g["x"])) for k, g in few.groupby(["label", "w"])})

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for k, g in pdf.groupby(["label", "w"]):
                if k in sent.value:
                    ids, q = sent.value[k]
                    x, own, n = unit(g["x"]), g["node"].to_numpy(), g["n"].to_numpy()
                    links = [n @ ((x @ q[lo : lo + 1024].T >= threshold) & (own[:, None] != ids[lo : lo + 1024])) for lo in range(0, len(ids), 1024)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(links).astype(np.int64))], names=["node", "links"])

    want = nodes.select("label", "w", "node", "n", "x").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("want"))
    both = want.join(found.groupBy("node").agg(F.sum("links").alias("got")), "node", "left")
    share = F.least("want", F.coalesce("got", F.lit(0))) / F.col("want")
    return [r["share"] for r in both.where("want > 0").groupBy(F.col("want") > many).agg(F.avg(share).alias("share")).collect()]
