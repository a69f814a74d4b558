"""Orders over whole tables without a task that holds one: rows dealt by range, what comes before a range summed over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

PART = "of_range"


def dealt(df: DataFrame, *by: str | Column) -> DataFrame:
    """df dealt by ranges of by, written, with its range's number. Equal rows of by are in one range."""
    return written(df.repartitionByRange(*by).withColumn(PART, F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: str, of: dict[str, str]) -> DataFrame:
    """df with, for each (name: column) of `of`, the sum of the column up to and with the row in the order of by, whose
    values are distinct. A window is over one range; only sums, a row for each range, meet in one task."""
    own = dealt(df, by)
    sums = own.groupBy(PART).agg(*(F.sum(c).alias(f"sum_{n}") for n, c in of.items()))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(PART, *(F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in of))
    inside = Window.partitionBy(PART).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(F.broadcast(starts), PART)
    return out.select(*df.columns, *((F.col(f"before_{n}") + F.sum(c).over(inside)).alias(n) for n, c in of.items()))


def least(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows of df in the order of by. Ranges before the one where n is reached come whole, that one in part."""
    own = dealt(df, *by)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy(PART).agg(F.count(F.lit(1)).alias("m")).select(PART, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*by))
    return own.join(F.broadcast(starts), PART).where(F.col("start") < n).withColumn("place", F.col("start") + place).where(F.col("place") <= n).select(*df.columns)


def nth(df: DataFrame, by: str, place: int) -> DataFrame:
    """One row (value): the value of by at that place from 0, in order; none if there are not so many rows."""
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("c"))
    return running(counts, by, {"upto": "c"}).where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(F.col(by).alias("value"))


def around(rows: DataFrame, knots: DataFrame, at: str, x: str = "x") -> DataFrame:
    """rows with `below` and `above`: the last knot not after at and the first not before it, as structs of knots' columns;
    null where there is none. knots have distinct x; rows of a null at have neither. Both are dealt by range together, and
    a range without a knot on one side takes that of its neighbours, of which there is a row for each range; so neither the
    knots nor rows of one value need be in one task."""
    own = F.struct(*(F.col(c) for c in rows.columns))
    knot = F.struct(*(F.col(c) for c in knots.columns))
    kind, none = dict(knots.select(knot.alias("k")).dtypes)["k"], dict(rows.select(own.alias("r")).dtypes)["r"]
    both = rows.where(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("x"), F.lit(1).alias("side"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), own.alias("row"), F.lit(None).cast(kind).alias("knot"))
    both = both.unionByName(knots.select(F.col(x).cast("double").alias("x"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast(none).alias("row"), knot.alias("knot")))
    both = dealt(both, "x", "side", "salt")
    ends = both.groupBy(PART).agg(F.max(F.when(F.col("side") == 0, F.struct("x", "knot"))).alias("last"), F.min(F.when(F.col("side") == 0, F.struct("x", "knot"))).alias("first"))
    before, after = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(PART, F.last("last.knot", True).over(before).alias("carried"), F.first("first.knot", True).over(after).alias("next"))
    up = Window.partitionBy(PART).orderBy("x", "side", "salt")
    out = both.join(F.broadcast(ends), PART)
    out = out.withColumn("below", F.coalesce(F.last("knot", True).over(up.rowsBetween(Window.unboundedPreceding, 0)), "carried"))
    # From the other end: a frame up to the last row would be read anew for every row.
    down = Window.partitionBy(PART).orderBy(F.desc("x"), F.desc("side"), F.desc("salt"))
    out = out.withColumn("above", F.coalesce(F.last("knot", True).over(down.rowsBetween(Window.unboundedPreceding, 0)), "next")).where("side = 1")
    # A knot of the very value stands before it in order.
    out = out.withColumn("above", F.when(F.col(f"below.{x}").cast("double") == F.col("x"), F.col("below")).otherwise(F.col("above")))
    found = out.select("row.*", "below", "above")
    lost = rows.where(F.col(at).isNull()).select("*", F.lit(None).cast(kind).alias("below"), F.lit(None).cast(kind).alias("above"))
    return found.unionByName(lost)
