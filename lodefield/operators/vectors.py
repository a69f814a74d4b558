"""Staged search: signs, then small integers, then the vectors themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import dot


def signs(x: Column, width: int) -> Column:
    """The signs of the components, 64 to a long."""
    words = []
    for lo in range(0, width, 64):
        bits = F.transform(F.slice(x, lo + 1, 64), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, n: s + n)


def scale(x: Column) -> Column:
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return F.when(top > 1e-8, top / 127).otherwise(F.lit(1 / 127))


def codes(x: Column, by: Column) -> Column:
    """Components as integers of -127 to 127."""
    return F.transform(x, lambda v: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(v.cast("double") / by))).cast("int"))


def staged(rows: DataFrame, query: DataFrame, k: int, width: int, oversample: tuple[int, int] = (16, 4), least: tuple[int, int] = (256, 64)) -> DataFrame:
    """(vec_id, score) of the k best by dot product, above 0, among those that signs and then 8-bit codes leave. query has
    one row with column q. Each stage keeps a bounded number of rows; ties go to the smaller id."""
    first, second = (max(n * k, m) for n, m in zip(oversample, least))
    own = rows.join(F.broadcast(query))
    near = own.select("vec_id", "embedding", "q", hamming(signs(F.col("embedding"), width), signs(F.col("q"), width)).alias("far")).orderBy("far", "vec_id").limit(first)
    ints = near.withColumn("sx", scale(F.col("embedding"))).withColumn("sq", scale(F.col("q")))
    approx = F.aggregate(F.zip_with(codes(F.col("embedding"), F.col("sx")), codes(F.col("q"), F.col("sq")), lambda a, b: a * b), F.lit(0), lambda s, p: s + p)
    short = ints.withColumn("approx", F.round(approx * F.col("sx") * F.col("sq"), 9)).orderBy(F.desc("approx"), "vec_id").limit(second)
    return short.select("vec_id", dot(F.col("embedding"), F.col("q")).alias("score")).where("score > 0").orderBy(F.desc("score"), "vec_id").limit(k)
