"""What of a store may leave it: decisions carried along lineage of any depth, rows left out by reason, fields redacted.

Rows have come through access.decide() (reason, allowed, redacted). Evidence names the evidence that it derives from, and
goes only if all of that, however far back, may go; claims and relations go with the evidence that they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import reached
from .lineage import written

WHOLE = "[REDACTED]"


def closed(evidence: DataFrame) -> DataFrame:
    """evidence (cid, sources, reason, allowed) with reason and allowed as lineage leaves them: a row of its own denial keeps
    it; one that derives, at any depth, from a denied row is `source_denied`, from a row that isn't there
    `source_missing`, where both `source_missing`. Null lists are empty, cycles are followed once."""
    own = written(evidence, "decided")
    links = own.select("cid", F.explode("sources").alias("source")).where("source is not null").distinct()
    links = written(links, "links")
    missing = links.select(F.col("source").alias("cid")).distinct().join(own.select("cid"), "cid", "left_anti")
    edges = links.select(F.col("source").alias("a"), F.col("cid").alias("b"))
    below = lambda seeds: reached(edges, seeds.select(F.col("cid").alias("node")).distinct()).where("hop > 0").select(F.col("node").alias("cid"))
    lost = below(missing).withColumn("why", F.lit("source_missing"))
    barred = below(own.where("not allowed")).withColumn("why", F.lit("source_denied"))
    why = lost.unionByName(barred).groupBy("cid").agg(F.max("why").alias("why"))
    out = own.join(why, "cid", "left")
    reason = F.when(F.col("allowed"), F.coalesce("why", "reason")).otherwise(F.col("reason"))
    return out.withColumns({"reason": reason, "allowed": F.col("allowed") & F.col("why").isNull()}).drop("why").select(*evidence.columns)


def with_sources(rows: DataFrame, evidence: DataFrame, key: str = "id") -> DataFrame:
    """rows (sources, reason, allowed) denied where a source of theirs is no allowed row of evidence (cid, allowed). A row
    without sources stays as it is decided."""
    named = rows.select(key, F.explode("sources").alias("cid")).distinct().join(evidence.select("cid", "allowed"), "cid", "left")
    why = named.groupBy(key).agg(F.max(F.when(F.col("allowed").isNull(), "source_missing").when(~F.col("allowed"), "source_denied")).alias("why"))
    out = rows.join(why, key, "left")
    return out.withColumns({"reason": F.when(F.col("allowed"), F.coalesce("why", "reason")).otherwise(F.col("reason")), "allowed": F.col("allowed") & F.col("why").isNull()}).drop("why").select(*rows.columns)


def names_in(kind: T.DataType) -> set[str]:
    """All names of fields in a type, at any depth."""
    if isinstance(kind, T.StructType):
        return {f.name.lower() for f in kind} | {n for f in kind for n in names_in(f.dataType)}
    if isinstance(kind, T.ArrayType):
        return names_in(kind.elementType)
    return names_in(kind.valueType) if isinstance(kind, T.MapType) else set()


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def masked(value: Column, kind: T.DataType, fields: Column) -> Column:
    """value without what fields (lower-case names) name in it, at any depth: strings become a mark with the name, other
    things null. What isn't named keeps its type and its nulls."""

    def named(inner: Column, of: T.DataType, name: Column) -> Column:
        mark = F.concat(F.lit("[REDACTED:"), name, F.lit("]")) if isinstance(of, T.StringType) else F.lit(None).cast(of)
        return F.when(F.array_contains(fields, F.lower(name)) & inner.isNotNull(), mark).otherwise(masked(inner, of, fields))

    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(named(value.getField(f.name), f.dataType, F.lit(f.name)).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType) and (names_in(kind) or _has_map(kind)):
        return F.transform(value, lambda x: masked(x, kind.elementType, fields))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(value, lambda k, v: named(v, kind.valueType, k))
    return value


def text_without(text: Column, fields: Column) -> Column:
    """text without the values that stand behind a field's name and a colon or equals sign; replaced whole if there are
    none, or no fields."""
    one = lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?i)(\b\Q"), f, F.lit(r"\E\b\s*[:=]\s*)([^,;\n]+)")), F.concat(F.lit("$1[REDACTED:"), f, F.lit("]")))
    out = F.aggregate(fields, text, one)
    return F.when(text.isNull(), text).when(out == text, F.lit(WHOLE)).otherwise(out)


def redacted(rows: DataFrame, keep: tuple[str, ...], fields: str = "redact_fields", flag: str = "redacted", texts: tuple[str, ...] = ()) -> DataFrame:
    """rows whose flag is set, without what the row's own fields name: in columns of any nesting, and behind their names in
    the columns `texts`. keep are columns that stay whatever they are named (keys, decisions). A row whose fields name
    nothing that the schema has, and that has no text, loses its other strings whole. Names are compared in lower case."""
    own = F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.lower(f))
    names = sorted({f.name.lower() for f in rows.schema} - {k.lower() for k in keep} | {n for f in rows.schema if f.name not in keep for n in names_in(f.dataType)})
    has_maps = any(_has_map(f.dataType) for f in rows.schema if f.name not in keep)
    hits = F.arrays_overlap(own, F.array(*map(F.lit, names)).cast("array<string>")) | F.lit(has_maps) | F.lit(bool(texts))
    out = []
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        if f.name in (*keep, fields, flag):
            out.append(c)
            continue
        is_text = isinstance(f.dataType, T.StringType)
        mark = F.lit(f"[REDACTED:{f.name}]") if is_text else F.lit(None).cast(f.dataType)
        inner = text_without(c, own) if f.name in texts else masked(c, f.dataType, own)
        value = F.when(F.array_contains(own, f.name.lower()) & c.isNotNull(), mark).otherwise(inner)
        value = F.when(hits, value).otherwise(F.lit(WHOLE) if is_text else c)
        out.append(F.when(F.coalesce(flag, F.lit(False)), value).otherwise(c).alias(f.name))
    return rows.select(*out)


def statement(subject: Column, predicate: Column, obj: Column, fields: Column, flag: Column, names: tuple[str, str, str] = ("subject", "predicate", "object")) -> Column:
    """The words of a claim, or of a relation by its own names: parts that fields name are replaced; where they name none,
    values behind their names, or all of it."""
    low = F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.lower(f))
    parts = [F.when(F.array_contains(low, n), F.lit(f"[REDACTED:{n}]")).otherwise(c) for n, c in zip(names, (subject, predicate, obj))]
    whole = F.concat_ws(" ", subject, predicate, obj)
    return F.when(~flag, whole).when(F.arrays_overlap(low, F.array(*map(F.lit, names))), F.concat_ws(" ", *parts)).otherwise(text_without(whole, low))


def disclosed(rows: DataFrame, collection: str) -> DataFrame:
    """(collection, reason, n) of what was left out, and of what was redacted of what was not."""
    return rows.groupBy(F.when(~F.col("allowed"), F.col("reason")).when(F.col("redacted"), "redacted").otherwise("whole").alias("reason")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(collection).alias("collection"), "reason", "n")
