"""Statistics of terms, corrections, associations, chains of hashes, embeddings of tokens, clauses."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, counted, fold, osa_at_most_one, tokenize
from .lineage import written
from .postings import runs

# Kinds and what belongs to them.
HYPONYMS = {
    "parent": "mother father mom dad".split(),
    "parents": "mother father mom dad".split(),
    "artist": "musician singer band songwriter composer rapper vocalist album song".split(),
    "artists": "musicians singers bands songwriters composers rappers vocalists".split(),
    "bike": "bicycle cycling biking".split(),
    "bikes": "bicycles bicycle bike".split(),
    "pet": "dog cat puppy kitten rabbit parrot hamster bird turtle".split(),
    "pets": "dogs cats dog cat puppies kittens rabbits parrots".split(),
}


def term_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, tf, idf, live_idf) of all tokens: one shuffle by term, of sums made within each task."""
    rows = docs.select(F.explode(counted(tokenize(F.col(text)))).alias("c"))
    own = rows.groupBy("c.term").agg(F.sum(F.col("c.first").cast("long")).alias("df"), F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return own.join(F.broadcast(n)).select("term", "df", "tf", F.round(idf, 6).alias("idf"), F.round(F.log((F.col("n") + 1.0) / (F.col("df") + 0.5)), 6).alias("live_idf"))


def hash_chain(rows: DataFrame, keys: list[str], order: list[str], entry: Column) -> DataFrame:
    """(keys, link_index, link_sha256): each key's rows in order, every link the sha256 of the one before, a colon and the
    entry's hash, from 64 zeros on. A chain is walked row by row, so one key is one task's work, in bounded memory."""
    schema = rows.select(*keys).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def walk(batches):
        last, at, link = None, 0, ""
        for batch in batches:
            own = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys)))))
            idx, links = [], []
            for key, e in zip(own, batch.column(len(keys)).to_pylist()):
                if key != last:
                    last, at, link = key, 0, "0" * 64
                link = hashlib.sha256(f"{link}:{e}".encode()).hexdigest()
                idx.append(at)
                links.append(link)
                at += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(idx, pa.int64()), pa.array(links)], names=[*keys, "link_index", "link_sha256"])

    own = rows.select(*keys, entry.alias("chain_entry"), *order).repartition(*keys).sortWithinPartitions(*keys, *order)
    return own.select(*keys, "chain_entry").mapInArrow(walk, f"{fields}, link_index long, link_sha256 string")


def corrections(unknown: DataFrame, known: DataFrame, least: int = 6) -> DataFrame:
    """(term, correction) of terms that are not known, each with the known terms one edit or swap away that begin alike.
    Words so near have the word itself or one of its one-letter deletions in common: these are joined, not all pairs."""
    fine = lambda c: (F.length(c) >= least) & c.rlike("^[a-z]+$")

    def near(df: DataFrame, name: str) -> DataFrame:
        c = F.col(name)
        gone = F.transform(F.sequence(F.lit(2), F.length(c)), lambda i: F.concat(F.substring(c, 1, i - 1), F.substr(c, i + 1)))
        return df.select(name, F.explode(F.array_distinct(F.concat(F.array(c), gone))).alias("variant"))

    new = unknown.join(known, "term", "left_anti").where(fine(F.col("term")))
    old = known.where(fine(F.col("term"))).select(F.col("term").alias("correction"))
    pairs = near(new, "term").join(near(old, "correction"), "variant").select("term", "correction").distinct()
    return pairs.where(osa_at_most_one(F.col("term"), F.col("correction")))


def expanded(terms: DataFrame) -> DataFrame:
    """(term, expansion): each term itself and what belongs to its kind."""
    kinds = F.create_map(*(x for k, v in HYPONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.concat(F.array("term"), F.coalesce(F.try_element_at(kinds, F.col("term")), F.array().cast("array<string>")))
    return terms.select("term", F.explode(own).alias("expansion"))


def associations(docs: DataFrame, least_docs: int, most_docs: int, least_pairs: int, least_pmi: float, text: str = "text") -> DataFrame:
    """(a, b, docs, ppmi) of terms a < b that occur in least_pairs documents together. Only terms of least_docs to
    most_docs documents are paired, so that a term makes pairs with no more than most_docs documents' terms."""
    u = docs.select("doc_id", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("t")).where(F.col("t").rlike("^[a-z]+$") & (F.length("t") > 2) & ~F.col("t").isin(STOPWORDS))
    df = u.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(least_docs, most_docs))
    n = docs.agg((F.count(F.lit(1)) + 2.0).alias("n"))
    inside = u.join(df, "t").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("t", "df"))).alias("ts"))
    pairs = inside.select(F.posexplode("ts").alias("i", "x"), "ts").select("x", F.explode(F.slice("ts", F.col("i") + 2, F.greatest(F.size("ts") - F.col("i") - 1, F.lit(0)))).alias("y"))
    both = pairs.groupBy(F.col("x.t").alias("a"), F.col("y.t").alias("b"), F.col("x.df").alias("da"), F.col("y.df").alias("db")).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least_pairs)
    pmi = F.log(F.col("docs") * F.col("n") / (F.col("da") * F.col("db"))) / F.log(F.lit(2.0))
    return both.join(F.broadcast(n)).where(pmi >= least_pmi).select("a", "b", "docs", F.round(F.greatest(F.lit(0.0), pmi), 4).alias("ppmi"))


def bigrams(docs: DataFrame, least: int, text: str = "text") -> DataFrame:
    """(a, b, n, pmi) of neighbouring words of three letters or more that occur `least` times."""
    words = docs.select(F.filter(F.regexp_extract_all(fold(F.col(text)), F.lit("[a-z]+"), 0), lambda x: F.length(x) > 2).alias("w"))
    two = words.where(F.size("w") > 1).select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    c = two.where("p.a <> p.b").groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    df = words.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg((F.count(F.lit(1)) + 2.0).alias("all"))
    own = c.join(df.select(F.col("t").alias("a"), F.col("df").alias("da")), "a").join(df.select(F.col("t").alias("b"), F.col("df").alias("db")), "b").join(F.broadcast(n))
    p = lambda x: F.col(x) / F.col("all")
    return own.select("a", "b", "n", F.round(F.greatest(F.lit(0.0), F.log(p("n") / (p("da") * p("db"))) / F.log(F.lit(2.0))), 4).alias("pmi"))


@lru_cache(maxsize=1 << 16)
def _place(token: str) -> tuple[int, float]:
    d = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "big"), 1.0 - 2.0 * (d[4] & 1)


def hashed(tokens: list[str], dims: int) -> np.ndarray:
    """Signed counts of tokens in hashed buckets, of length 1 unless there is none."""
    out = np.zeros(dims)
    for t in tokens:
        at, sign = _place(t)
        out[at % dims] += sign
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def hashed_rows(tokens: pa.ListArray, dims: int) -> np.ndarray:
    """hashed() of each row: a distinct token of a batch is hashed once, and no token is a Python object of its own."""
    flat, lengths = tokens.flatten(), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode()
    places = [_place(t) for t in codes.dictionary.to_pylist()]
    at, sign = (np.array([p[i] for p in places], kind) for i, kind in ((0, np.int64), (1, np.float64)))
    own, rows = codes.indices.to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
    out = np.bincount(rows * dims + at[own] % dims, sign[own], len(lengths) * dims).reshape(len(lengths), dims)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm, norm, 1.0)


#: Tokens that are hashed at a time.
MOST_TOKENS = 1 << 20


def pieces(batch: pa.RecordBatch, tokens: int) -> list[pa.RecordBatch]:
    """Parts of a batch with so many tokens, in the column of that number, that memory does not follow the batch's texts."""
    upto = np.cumsum(batch.column(tokens).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(upto // MOST_TOKENS)) + 1
    ends = [0, *cuts.tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(ends, ends[1:])]


def likeness(tokens: DataFrame, vector: list[float], dims: int) -> DataFrame:
    """(the other columns, score) of rows (.., tokens): the product of their hashed embeddings and a vector. Of a row only the
    product comes back."""
    others = [c for c in tokens.columns if c != "tokens"]

    def run(batches):
        q = np.array(vector)
        for batch in batches:
            for part in pieces(batch, len(others)):
                score = np.array([v @ q for v in hashed_rows(part.column(len(others)), dims)], float)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], names=[*others, "score"])

    own = tokens.select(*others, "tokens")
    return own.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in own.dtypes[:-1]) + ", score double")


def hashed_embeddings(docs: DataFrame, dims: int, text: str = "text") -> DataFrame:
    """(doc_id, tokens, embedding) of every text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                vectors = hashed_rows(part.column(1), dims)
                lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, dims, dtype=np.int32), vectors.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["doc_id", "tokens", "embedding"])

    own = docs.select("doc_id", tokenize(F.col(text)).alias("tokens"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, tokens array<string>, embedding array<double>")


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of each span, one after another."""
    return np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


#: Stands for no last y.
NO_LAST = (1 << 63) - 1


def _sure(base: int, most: int):
    """Of (docs, ys), the ys of that many documents, (x, y) for each x of ys and the first ys that are in no other documents: no
    y is stronger. Of a batch each x has its `most` first."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                ys, n = part.column(1).flatten().to_numpy(), part.column(1).value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                at = np.flatnonzero(ys % base == part.column(0).to_numpy()[row])
                each = np.bincount(row[at], minlength=len(n))
                first = np.cumsum(each) - each
                few = np.minimum(each, most + 1)[row]  # x itself may be one of them
                x, y = np.repeat(ys, few), ys[at[_spans(first[row], few)]]
                x, y = x[x != y], y[x != y]
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                kept = np.arange(len(x)) - np.searchsorted(x, x) < most
                yield pa.RecordBatch.from_arrays([pa.array(x[kept], pa.int64()), pa.array(y[kept], pa.int64())], names=["x", "y"])

    return run


def _sent(base: int):
    """Of (docs, ys, lasts), for each x of ys the others that may be among its strongest, (x, ys, docs). With a last y there are
    enough that are as strong as any: what follows it, or is in more documents than x, is behind them."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                ys, last, n = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy(), part.column(1).value_lengths().to_numpy().astype(np.int64)
                first = np.cumsum(n) - n
                upto = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(ys[a : a + k], last[a : a + k], "right") for a, k in zip(first, n))])
                first, docs = np.repeat(first, n), np.repeat(part.column(0).to_numpy(), n)
                cuts = np.flatnonzero(np.diff(np.cumsum(upto) // MOST_TOKENS)) + 1
                for own in np.split(np.arange(len(ys)), cuts):
                    x, y = np.repeat(own, upto[own]), ys[_spans(first[own], upto[own])]
                    may = (y != ys[x]) & ((last[x] == NO_LAST) | (y % base <= ys[x] % base * 1.001))
                    x, y = x[may], y[may]
                    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(x)], pa.int32()), pa.array(y, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(ys[x[new]], pa.int64()), lists, pa.array(docs[x[new]], pa.int64())], names=["x", "ys", "docs"])

    return run


def _strongest(base: int, most: int):
    """Of (x, ys) in the order of x, for each x the ys that may be its `most` strongest, and how many ys hold each (docs); a third
    column says how many documents have the ys, else one. A number is a term's place times base, plus its df; the strength of
    a pair grows with docs / df of y. Of ys that are as strong the first are enough; what the rounding of strengths may make
    equal is kept."""

    def merged(x: np.ndarray, y: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((y, x))
        x, y, docs = x[order], y[order], docs[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)])
        return x[first], y[first], np.add.reduceat(docs, first) if len(first) else docs

    def few(x: np.ndarray, y: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        other = x != y
        x, y, docs = x[other], y[other], docs[other]
        ratio = docs / (y % base)
        order = np.lexsort((y, -ratio, x))
        x, y, docs, ratio = x[order], y[order], docs[order], ratio[order]
        place = np.arange(len(x))
        new = np.r_[True, x[1:] != x[:-1]][: len(x)]
        start = np.maximum.accumulate(np.where(new, place, 0))
        same = np.maximum.accumulate(np.where(new | np.r_[True, ratio[1:] != ratio[:-1]][: len(x)], place, 0))
        end = np.r_[np.flatnonzero(new)[1:], len(x)][np.cumsum(new) - 1]
        least = ratio[np.minimum(start + most, end) - 1] if len(x) else ratio
        kept = (place - same < most) & (ratio >= least * 0.999)
        return pa.RecordBatch.from_arrays([pa.array(c[kept], pa.int64()) for c in (x, y, docs)], names=["x", "y", "docs"])

    def run(batches):
        held = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for part in pieces(batch, 1):
                n = part.column(1).value_lengths().to_numpy()
                docs = part.column(2).to_numpy() if part.num_columns > 2 else np.ones(len(n), np.int64)
                more = np.repeat(part.column(0).to_numpy(), n), part.column(1).flatten().to_numpy(), np.repeat(docs, n)
                x, y, docs = merged(*(np.r_[a, b] for a, b in zip(held, more)))
                upto = int(np.searchsorted(x, x[-1])) if len(x) else 0  # the last may go on in the next batch
                if upto:
                    yield few(x[:upto], y[:upto], docs[:upto])
                held = x[upto:], y[upto:], docs[upto:]  # a row for each y, however many lists there are
        yield few(*held)

    return run


def contextual_embeddings(docs: DataFrame, dims: int, least_docs: int = 1, most_docs: int | None = None, neighbours: int = 4, least_pmi: float = 0.25) -> DataFrame:
    """(doc_id, embedding): three quarters of the hashed embedding and a quarter of those of each token's strongest
    associated terms, weighed by their association up to a half. Associations are those of associations(), of all terms unless
    least_docs or most_docs are given. Equal sets of terms are one list, sent, as numbers in the order of terms, to its terms: no
    pair is a row. A term with enough partners that are only where it is too is sent no more than what can precede the last."""
    tokens = written(docs.select(F.monotonically_increasing_id().alias("row_at"), "doc_id", tokenize(F.col("text")).alias("tokens")), "tokens")
    n = tokens.count()
    base, t = n + 1, F.col("term")
    u = tokens.select("row_at", F.explode(runs(F.col("tokens"))).alias("c")).select("row_at", "c.*").where(t.rlike("^[a-z]+$") & (F.length(t) > 2) & ~t.isin(STOPWORDS))
    df = u.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(least_docs, n if most_docs is None else most_docs))
    terms = written(df.repartitionByRange("term").sortWithinPartitions("term").withColumn("at", F.monotonically_increasing_id()), "terms")
    part, nth = F.shiftright("at", 33), F.col("at") % (1 << 33)  # an id has its partition above 33 bits
    width = terms.agg(F.max(nth)).first()[0] or 0
    terms = terms.select("term", ((part * (width + 1) + nth) * base + F.col("df")).alias("x"))
    inside = written(u.join(terms, "term").select("row_at", "x", "tf"), "inside")
    rows = inside.groupBy("row_at").agg(F.array_sort(F.collect_list("x")).alias("ys"))
    lists = written(rows.groupBy("ys").agg(F.count(F.lit(1)).alias("docs")).withColumn("list_at", F.monotonically_increasing_id()), "lists")
    nth_of = lambda *order: F.row_number().over(Window.partitionBy("x").orderBy(*order))
    lasts = lists.select("docs", "ys").mapInArrow(_sure(base, neighbours), "x long, y long").withColumn("r", nth_of("y")).where(F.col("r") == neighbours).select("x", F.col("y").alias("last"))
    c = F.struct("x", F.coalesce("last", F.lit(NO_LAST)).alias("last"))
    ready = lists.select("list_at", "docs", F.explode("ys").alias("x")).join(lasts, "x", "left").groupBy("list_at").agg(F.max("docs").alias("docs"), F.array_sort(F.collect_list(c)).alias("c"))
    sent = ready.select("docs", F.col("c.x").alias("ys"), F.col("c.last").alias("lasts")).mapInArrow(_sent(base), "x long, ys array<long>, docs long")
    found = sent.repartition("x").sortWithinPartitions("x").mapInArrow(_strongest(base, neighbours), "x long, y long, docs long")
    pmi = F.log(F.col("docs") * F.lit(n + 2.0) / ((F.col("x") % base) * (F.col("y") % base))) / F.log(F.lit(2.0))
    pairs = found.where(pmi >= least_pmi).select("x", "y", F.round(F.greatest(F.lit(0.0), pmi), 4).alias("ppmi"))
    best = pairs.withColumn("r", nth_of(F.desc("ppmi"), "y")).where(F.col("r") <= neighbours)

    @F.pandas_udf("long")
    def spot(term: pd.Series) -> pd.Series:
        """A term's bucket, from 1 on, with its sign."""
        return pd.Series([int((1 + at % dims) * sign) for at, sign in map(_place, term)], dtype="int64")

    near = best.join(terms.select(F.col("x").alias("y"), spot("term").alias("spot")), "y").groupBy("x").agg(F.collect_list(F.struct("spot", F.least(F.col("ppmi") / 4, F.lit(0.5)).alias("w"))).alias("of"))
    weighed = F.transform("of", lambda o: F.struct(o["spot"].alias("spot"), (o["w"] * F.col("tf")).alias("w")))
    extra = inside.join(near, "x").groupBy("row_at").agg(F.array_sort(F.flatten(F.collect_list(weighed))).alias("near"))

    def combine(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                own, spots = hashed_rows(part.column(1), dims), part.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(len(own)), part.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                more = np.bincount(row * dims + np.abs(spots) - 1, np.sign(spots) * part.column(3).flatten().to_numpy(), own.size).reshape(own.shape)
                mix = 0.75 * own + 0.25 * more
                norm = np.sqrt((mix * mix).sum(axis=1, keepdims=True))
                added = (np.bincount(row, minlength=len(own)) > 0)[:, None] & (norm > 1e-12)
                out = np.where(added, mix / np.where(added, norm, 1.0), own)
                vectors = pa.ListArray.from_arrays(np.arange(0, out.size + 1, dims, dtype=np.int32), out.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["doc_id", "embedding"])

    both = tokens.join(extra, "row_at", "left").select("doc_id", "tokens", F.col("near.spot").alias("spots"), F.col("near.w").alias("ws"))
    return both.mapInArrow(combine, f"doc_id {dict(both.dtypes)['doc_id']}, embedding array<double>")


# Where coordinated claims are parted, and words that begin a claim of one's own.
_COORDINATED = (
    r"(?i)\s+(?:and|but)\s+(?=(?:I|we|my|our)\b|(?:work|works|worked|live|lived|reside|resided|like|love|prefer|hate|own|use|have|am|was|speak|study|studied|"
    r"graduated|moved|decided)\b)"
)


def clauses(text: Column) -> Column:
    """Independent claims of a text; a claim without a subject is given its sentence's I or We."""

    def of(sentence: Column) -> Column:
        speaker = F.regexp_extract(sentence, r"(?i)^\s*(I|We)\b", 1)
        named = lambda p, i: F.when((i > 0) & (speaker != "") & ~p.rlike(r"(?i)^(I|we|my|our)\b"), F.concat(speaker, F.lit(" "), p)).otherwise(p)
        parts = F.transform(F.split(sentence, _COORDINATED), lambda p, i: F.struct(F.regexp_replace(p, r"^\s+|\s+$", "").alias("p"), i.alias("i")))
        return F.transform(F.filter(parts, lambda x: x["p"] != ""), lambda x: named(x["p"], x["i"]))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|[;\n]+"), of))


_LABEL = re.compile(r"^(User|Assistant|Human|AI):\s*", re.MULTILINE | re.IGNORECASE)


def speaker_spans(text: Column) -> Column:
    """The turns of a labelled text as ranges of its characters; a text without labels is one turn of the user's."""

    @F.pandas_udf("array<struct<speaker: string, span_start: long, span_end: long>>")
    def spans(texts: pd.Series) -> pd.Series:
        def one(whole: str):
            found = list(_LABEL.finditer(whole))
            ends = [m.start() for m in found[1:]] + [len(whole)]
            return [{"speaker": m[1].lower(), "span_start": m.end(), "span_end": e} for m, e in zip(found, ends)] or [{"speaker": "user", "span_start": 0, "span_end": len(whole)}]

        return texts.map(lambda t: None if t is None else one(t))

    return spans(text)


# What a person says of themselves, and the attribute it states. The group is the attribute's value.
_SAID = (
    ("residence", r"\b(?:I|[Ww]e)(?: now| still)? (?:do not |don't |no longer )?(?:live|reside) in ([A-Z][\w ]*\w)"),
    ("work_at", r"\b(?:I|[Ww]e)(?: now| still)? (?:do not |don't |no longer )?work (?:at|for) ([A-Z][\w ]*\w)"),
    ("name", r"\b(?:[Mm]y name is|I am called) ([A-Z][\w]*)"),
    ("like", r"\b(?:I|[Ww]e)(?: really)? (?:do not |don't |no longer )?(?:like|love|enjoy) ([\w ]*\w)"),
    ("own", r"\b(?:I|[Ww]e) (?:do not |don't |no longer )?(?:own|have) (?:a |an |the )?([\w ]*\w)"),
    ("speak", r"\b(?:I|[Ww]e) (?:do not |don't |no longer )?speak ([A-Z]\w*)"),
)


def claims(text: Column) -> Column:
    """(predicate, object, negative) of what a text's clauses state of who says them."""
    own = F.transform(
        clauses(text),
        lambda c: F.filter(
            F.array(*(F.struct(F.lit(p).alias("predicate"), F.regexp_extract(c, pattern, 1).alias("object"), c.rlike(r"(?i)\b(?:do not|don't|no longer)\b").alias("negative")) for p, pattern in _SAID)),
            lambda x: x["object"] != "",
        ),
    )
    return F.flatten(own)
