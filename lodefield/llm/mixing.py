"""Temperature mixing: source weights are token shares to a power, found by bisection, and realised in block permutations.

The power of 1 keeps the shares, 0 makes all sources equal. Sums over sources are made by Spark for a grid of powers at a
time, so that the driver gets a few numbers however many sources there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, packed


def counted(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens): tokens are words; a null text has none."""
    spaces = SPACE.replace("[", "[^", 1)
    return docs.select("doc_id", F.col(source).alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(spaces)).cast("long").alias("n_tokens"))


def shares(rows: DataFrame) -> DataFrame:
    """(source, docs, tokens) of each source."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def exponent(sources: DataFrame, entropy: float, repeats: float, budget_ratio: float, least_once: bool = False, steps: int = 5) -> dict:
    """The largest power whose weights' entropy is `entropy` of its maximum, raised where a source would be repeated
    more than `repeats` times. least_once: the budget is then such that no source is taken less than once.

    Returns power, z (the weights' sum), total and budget in tokens, sources. Sources without tokens get no weight."""
    live = sources.where("tokens > 0")
    n, total, least, most = live.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return {"power": 1.0, "z": 1.0, "total": 0, "budget": 0.0, "sources": 0}
    p = F.col("tokens") / F.lit(float(total))

    def at(powers: list[float]) -> list[tuple[float, float]]:
        """(z, entropy) for each power."""
        got = live.agg(*(f for a in powers for f in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))))).first()
        return [(z, math.log(z) - a * s / z) for a, z, s in zip(powers, got[::2], got[1::2])]

    def budget(a: float, z: float) -> float:
        return total * budget_ratio * max(1.0, z * (most / total) ** (1 - a) if least_once else 1.0)

    def repeated(a: float, z: float) -> float:
        return (least / total) ** (a - 1) / z * budget(a, z) / total

    def bisect(holds) -> float:
        """The end of the interval in [0, 1] where `holds` turns; holds(1) or holds(0) may be false or true throughout."""
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            grid = [lo + (hi - lo) * i / 16 for i in range(17)]
            ok = [holds(a, *x) for a, x in zip(grid, at(grid))]
            k = next((i for i, x in enumerate(ok) if not x), 17)
            if k in (0, 17):
                return lo if k == 0 else hi
            lo, hi = grid[k - 1], grid[k]
        return lo

    power = bisect(lambda a, z, h: h >= entropy * math.log(n)) if n > 1 else 1.0
    floor = bisect(lambda a, z, h: repeated(a, z) > repeats)
    power = min(1.0, max(power, floor + 17.0**-steps if floor > 0 else 0.0))
    z, h = at([power])[0]
    return {"power": power, "z": z, "total": total, "budget": budget(power, z), "sources": n, "entropy": h}


def mixed_in(docs: DataFrame, source: str = "source", entropy: float = 0.95, repeats: float = 4.0, budget_ratio: float = 1.0, least_once: bool = False, seed: int = 7, block_docs: int = 256, most_blocks: int = 32_768, marks: bool = True) -> DataFrame:
    """docs with each row as often as the mix takes it, and mix_epoch, mix_block, mix_at (columns of these names are
    replaced): sorted by epoch, block and mix_at, each source's rows stand in its permutation. Without marks the columns
    are those that came in, whatever their names.

    Needs doc_id, text and the source column; a null source is a source too. Rows of equal source and doc_id go together.
    Sources without a word are not taken. No rows: no rows.
    A source's documents are dealt into blocks by hash; whole epochs take all blocks, and the rest of a source's budget
    takes whole blocks in their permuted order and then documents of the next block as long as they start within it.
    """
    rows = cut(counted(docs, source), "mix")
    sources = cut(shares(rows), "mix")
    found = exponent(sources, entropy, repeats, budget_ratio, least_once)
    n_docs = sources.agg(F.sum("docs")).first()[0] or 0
    size = max(block_docs, -(-n_docs // most_blocks))
    p = F.col("tokens") / F.lit(float(max(found["total"], 1)))
    quota = F.when(F.col("tokens") > 0, F.pow(p, F.lit(found["power"])) / F.lit(found["z"]) * F.lit(float(found["budget"]))).otherwise(F.lit(0.0))
    # Rounding errors must neither cost a source its last document nor give it a first one again.
    plan = sources.withColumn("quota", quota).withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9))).otherwise(0))
    left = F.col("quota") - F.col("whole") * F.col("tokens")
    plan = plan.select(F.col("source").alias("of"), F.ceil(F.col("docs") / F.lit(size)).cast("long").alias("blocks"), "whole", F.when(left >= 0.5, left).otherwise(F.lit(0.0)).alias("rest"))
    plan = cut(plan, "mix")
    few = lambda df, most: F.broadcast(df) if df.limit(most + 1).count() <= most else df
    side = few(plan, 100_000)
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "doc_id"), F.col("blocks"))
    dealt = rows.join(side, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "n_tokens", block.alias("block"), "whole", "rest")
    sums = dealt.groupBy("source", "block", "whole", "rest").agg(F.sum("n_tokens").alias("tokens"))
    turn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "source", "block"), "block")
    sums = sums.withColumn("mix_block", F.row_number().over(turn) - 1).withColumn("start", F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    sums = cut(sums.withColumn("state", F.when(F.col("start") + F.col("tokens") <= F.col("rest"), 2).when(F.col("start") < F.col("rest"), 1).otherwise(0)), "mix")
    # In the one block of each source that the rest ends in.
    edge = sums.where("state = 1").select(F.col("source").alias("of"), F.col("block").alias("b"), (F.col("rest") - F.col("start")).alias("left"))
    inside = dealt.join(few(edge, 100_000), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    inside = inside.groupBy("source", "doc_id", "left").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("start", F.sum("n").over(order) - F.col("n")).where(F.col("start") < F.col("left"))
    inside = cut(inside.select(F.col("source").alias("in_source"), F.col("doc_id").alias("in_doc"), F.lit(1).alias("in_edge")), "mix")
    blocks = sums.select(F.col("source").alias("of"), F.col("block").alias("b"), "mix_block", "whole", "state")
    names = ("mix_epoch", "mix_block", "mix_at") if marks else ()
    own = docs.select(packed(docs, "mix_row", names), F.col(source).alias("mix_source"), F.col("doc_id").alias("mix_doc"))
    n_blocks = plan.select(F.col("of").alias("p_of"), F.col("blocks").alias("mix_blocks"))
    out = own.join(few(n_blocks, 100_000), F.col("mix_source").eqNullSafe(F.col("p_of")))
    b = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "mix_doc"), F.col("mix_blocks"))
    out = out.withColumn("mix_b", b).join(few(blocks, 2 * most_blocks), F.col("mix_source").eqNullSafe(F.col("of")) & (F.col("mix_b") == F.col("b")))
    out = out.join(few(inside, 200_000), F.col("mix_source").eqNullSafe(F.col("in_source")) & F.col("mix_doc").eqNullSafe(F.col("in_doc")), "left")
    times = (F.col("whole") + (F.col("state") == 2).cast("int") + ((F.col("state") == 1) & F.col("in_edge").isNotNull()).cast("int")).cast("int")
    out = out.withColumn("mix_times", times).where("mix_times > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1)))
    out = out.withColumn("mix_at", F.xxhash64(F.lit(seed), "mix_doc"))
    return out.select("mix_row.*", *names)
