"""Passages of conversations, scored at three sizes: whole sessions, rounds and a user's turns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IRREGULAR, STOPWORDS, stem, tokenize
from .lineage import written

# How much words, stems and the user's own stems count, words of a query that matter less, and by how much.
RAW, STEM, OWN = 0.30, 0.20, 0.75
SUB_RAW, SUB_STEM = 0.35, 0.65
MINOR = (
    "order earliest latest chronological related average older younger five six seven eight nine ten worked work bought buy spent spend use used participate "
    "participated participating visit visited mention mentioned event events activity activities money expense expenses"
).split()
PROPER, SECONDARY, FUNCTION = 1.45, 0.20, 0.05


def weights(query: str) -> Column:
    """(term, weight) of a query's tokens: names count more, modifiers little where there is a topic, function words next
    to nothing where there is content."""
    q = F.lit(query)
    words = F.regexp_extract_all(q, F.lit("[A-Za-z0-9]+"), 0)
    proper = F.transform(F.filter(words, lambda w, i: w.rlike("^[A-Z]") & ((i > 0) | ~F.lower(w).isin(STOPWORDS))), F.lower)
    tokens = tokenize(q)
    is_content = lambda t: ~t.isin(STOPWORDS) & (F.length(t) > 2) & ~t.contains("-")
    topic = F.exists(tokens, lambda t: is_content(t) & ~t.isin(MINOR))
    any_content = F.exists(tokens, is_content)

    def weight(t: Column) -> Column:
        n = F.size(F.filter(tokens, lambda x: x == t)).cast("double")
        name = F.array_contains(proper, t)
        content = F.when(name, n * PROPER).when(topic & t.isin(MINOR), n * SECONDARY).otherwise(n)
        return F.when(~any_content, n).when(is_content(t), content).otherwise(n * FUNCTION)

    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), weight(t).alias("weight")))


def rounds(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with a role of user or assistant and their round: a user's turn and the answer that
    follows it are one, as is an answer alone."""
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = turns.select("conv_id", "turn", role.alias("role"), "text")
    return own.withColumn("round", F.when((F.col("role") == "assistant") & (F.lag("role").over(w) == "user"), F.lag("turn").over(w)).otherwise(F.col("turn")))


def scores(turns: DataFrame, query: str, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """(conv_id, session, best_round, best_turn, score) of conversations (conv_id, turn, role, text): the session's words and
    stems and the user's stems, and half of the best round's and of the best turn's. How rare a term is, is counted over
    sessions at all sizes. A round is a user's turn and the answer that follows it, or an answer alone."""
    own = rounds(turns).select("conv_id", "turn", "role", "round", tokenize(F.col("text")).alias("t"))
    # Only tokens that are a query's, begin like one of its stems, or are irregular, are kept.
    q = turns.sparkSession.range(1).select(weights(query).alias("w")).select(F.transform("w", lambda w: w["term"]).alias("terms"))
    q = q.select("terms", F.transform("terms", lambda t: F.substring(stem(t), 1, 2)).alias("heads"))  # one row
    odd = F.array(*map(F.lit, IRREGULAR))
    near = F.filter("t", lambda t: F.array_contains(F.col("terms"), t) | F.array_contains(odd, t) | F.array_contains(F.col("heads"), F.substring(t, 1, 2)))
    own = written(own.join(F.broadcast(q)).select("conv_id", "turn", "role", "round", F.size("t").alias("len"), near.alias("t")), "turns")
    hits = own.select("conv_id", "round", "turn", "role", F.explode("t").alias("term")).groupBy("conv_id", "round", "turn", "role", "term").agg(F.count(F.lit(1)).alias("n"))
    return scored(own.drop("t"), hits, query, alpha, beta)


def scored(own: DataFrame, hits: DataFrame, query: str, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """scores() of turns (conv_id, round, turn, role, len) from the terms of them (conv_id, round, turn, role, term, n) that a
    query's words or stems can be. On the driver are the query's terms, with a weight and a number of sessions each."""
    spark = own.sparkSession
    asked = spark.range(1).select(F.explode(weights(query)).alias("w")).select("w.*", stem(F.col("w.term")).alias("stem")).collect()
    words = {r["term"]: r["weight"] for r in asked}
    stems: dict[str, float] = {}
    for r in asked:
        stems[r["stem"]] = max(r["weight"], stems.get(r["stem"], 0.0))
    user = F.col("role") == "user"
    is_word, is_stem = F.col("term").isin(list(words)), F.col("stem").isin(list(stems))
    both = written(hits.withColumn("stem", stem(F.col("term"))).where(is_word | is_stem), "hits")
    sessions = own.agg(F.countDistinct("conv_id")).first()[0]

    def rare(rows: DataFrame, column: str, of: dict[str, float], share: float) -> Column:
        """What a term's occurrences count, by how many sessions have it."""
        df = {r[column]: r["df"] for r in rows.where(F.col(column).isin(list(of))).groupBy(column).agg(F.countDistinct("conv_id").alias("df")).collect()}
        known = {t: share * of[t] * math.log(1 + (sessions - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        return F.try_element_at(F.create_map(*(F.lit(x) for p in known.items() for x in p)), F.col(column)) if known else F.lit(None).cast("double")

    def level(key: list[str], rows: DataFrame, lengths: DataFrame, parts: list[tuple[str, Column]]) -> DataFrame:
        """(key, part): BM25 over rows of one size, with the terms' weights by word and by stem."""
        lengths = lengths.groupBy(*key).agg(F.sum("len").alias("len"))
        mean = max(lengths.agg(F.avg("len")).first()[0] or 0.0, 1.0)
        counts = [rows.groupBy(*key, F.col(c).alias("t")).agg(F.sum("n").alias("n")).withColumn(c, F.col("t")).select(*key, "n", w.alias("w")) for c, w in parts]
        found = counts[0]
        for more in counts[1:]:
            found = found.union(more)
        norm = 1.2 * (0.25 + 0.75 * F.col("len") / mean)
        return found.where("w is not null").join(lengths, key).groupBy(*key).agg(F.sum(F.col("w") * F.col("n") * 2.2 / (F.col("n") + norm)).alias("part"))

    mine, theirs = both.where(user), own.where(user)
    whole = [("term", rare(both, "term", words, RAW)), ("stem", rare(both, "stem", stems, STEM))]
    small = [("term", rare(both, "term", words, SUB_RAW)), ("stem", rare(both, "stem", stems, SUB_STEM))]
    session = level(["conv_id"], both, own, whole).union(level(["conv_id"], mine, theirs, [("stem", rare(mine, "stem", stems, OWN))]))
    session = written(session.groupBy("conv_id").agg(F.sum("part").alias("session")), "sessions")
    best = lambda key, rows, lengths, name: written(level(["conv_id", key], rows, lengths, small).groupBy("conv_id").agg(F.max("part").alias(name)), name)
    out = own.select("conv_id").distinct().join(session, "conv_id", "left").join(best("round", both, own, "best_round"), "conv_id", "left").join(best("turn", mine, theirs, "best_turn"), "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = out.select("conv_id", zero("session"), zero("best_round"), zero("best_turn"))
    return out.withColumn("score", F.col("session") + alpha * F.col("best_round") + beta * F.col("best_turn"))
