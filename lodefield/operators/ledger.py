"""Entries of a ledger that repeat each other."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .belief import folded


def deduplicated(rows: DataFrame) -> DataFrame:
    """(owner, seq) of the entries that stay, of rows (owner, seq, key, entity, value, quote) in the order of seq. Two repeat
    each other if their keys are equal, or their names and either both values (to the cent) or just one has a value. Of
    the two the one with a value stays, else that of the longer quote. An owner's entries are folded in one task, owner after
    owner."""
    article = re.compile(r"^(?:a|an|the|my|some)\s+")

    def fold(group: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for row in group:
            row["entity"] = article.sub("", row["entity"].strip().lower())
            row["paid"] = row["value"] is not None and row["value"] == row["value"]
            for i, old in enumerate(kept):
                named = row["entity"] == old["entity"]
                if row["key"] == old["key"] or (named and (row["paid"] != old["paid"] or not row["paid"] or round(row["value"], 2) == round(old["value"], 2))):
                    if row["paid"] > old["paid"] or (row["paid"] == old["paid"] and len(row["quote"]) > len(old["quote"])):
                        kept[i] = row
                    break
            else:
                kept.append(row)
        return kept

    own = rows.selectExpr("cast(owner as long) as owner", "cast(seq as long) as seq", "key", "entity", "cast(value as double) as value", "quote")
    own = own.repartition("owner").sortWithinPartitions("owner", "seq")
    return folded(own, ["owner"], pa.schema([("owner", pa.int64()), ("seq", pa.int64())]), "owner long, seq long", fold)
