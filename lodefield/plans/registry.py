"""Where queries and their SQL are kept, and how a query that both engines take as SQL is written once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import importable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations benchmark".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_EITHER = re.compile("⟦([^⟦⟧¦]*)¦([^⟦⟧]*)⟧")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, name: str = "documents") -> str:
    """The path of the stored index of a table's texts, made the first time it is asked for."""
    from ..operators import postings

    return postings.kept(table(spark, sf_dir, name), f"{sf_dir}/{name}", postings.add_turns if name == "conversations" else postings.add)


def either(sql: str) -> tuple[str, str]:
    """The two wordings of SQL in which ⟦a¦b⟧ stands for a in Spark and for b in DuckDB."""
    spark, duck = sql, sql
    while _EITHER.search(spark):
        spark, duck = _EITHER.sub(r"\1", spark), _EITHER.sub(r"\2", duck)
    return spark, duck


def num(x: float | str) -> str:
    """A double literal in both engines."""
    return f"⟦{x}D¦{x}::double⟧"


def regex(pattern: str) -> str:
    """A string literal without escapes in both engines."""
    return f"⟦r¦⟧'{pattern}'"


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over the tables that it names, and over frames by their names."""
    known = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)} | frames
    sql = sql.replace("{", "{{").replace("}", "}}")
    sql = re.sub(r"\b(from|join)(\s+)(" + "|".join(known) + r")\b", r"\1\2{\3}", sql, flags=re.I)
    return spark.sql(sql, **{k: v for k, v in known.items() if "{" + k + "}" in sql})


def plain(name: str, sql: str) -> None:
    """A query that both engines take as SQL."""
    own, oracle = either(sql)
    QUERIES[name], ORACLES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, own), oracle


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = either(oracle)[1]
        return f

    return add
