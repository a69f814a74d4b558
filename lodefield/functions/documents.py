"""Documents in parts, text of pages, containment of JSON."""

from __future__ import annotations

import html as _html
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Stands where a text is parted; not a character of texts.
_MARK = "\x02"


def paragraphs(text: Column, chunk: int = 2048) -> Column:
    """The text in parts that make it up again: paragraphs with the blank lines behind them, cut every `chunk` characters."""
    if not 64 <= chunk <= 16384:
        raise ValueError("chunk must be of 64 to 16384 characters")
    parts = F.filter(F.split(F.regexp_replace(text, r"((?:\r?\n)[\t ]*(?:\r?\n)(?:[\t ]*\r?\n)*)", f"$1{_MARK}"), _MARK), lambda p: p != "")
    pieces = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / chunk).cast("int")), lambda i: F.substr(p, i * chunk + 1, F.lit(chunk)))
    return F.flatten(F.transform(parts, pieces))


def sentences(text: Column) -> Column:
    # F.trim itself would get a sentence's number as the characters to trim.
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def windows(text: Column, size: int = 3, stride: int = 2) -> Column:
    """A text's blank-line paragraphs where it has several, else windows of `size` sentences where it has more, else itself."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def moved(s: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / stride).cast("int")), lambda i: F.array_join(F.slice(s, i * stride + 1, size), " "))
        return F.when(F.size(s) > size, steps).otherwise(F.array(text))

    return let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(let(sentences(text), moved)))


def page_text(page: Column) -> Column:
    """The words of an HTML page: no scripts, styles, comments or tags; blocks are lines; entities are what they stand for."""
    t = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<!DOCTYPE[^>]*>", "")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title|/section|/article|/header|/footer|/nav|/ul|/ol|/table|/blockquote)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def unescaped(text: Column) -> Column:
    """All named and numbered entities, for pages that hold rarer ones."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _html.unescape(t))

    return run(text)


def _holds(whole, part) -> bool:
    if type(part) is dict:
        return type(whole) is dict and all(k in whole and _holds(whole[k], v) for k, v in part.items())
    if type(part) is list:
        return type(whole) is list and len(whole) == len(part) and all(map(_holds, whole, part))
    return type(whole) is type(part) and whole == part


def json_contains(document: Column, pattern: str) -> Column:
    """Whether a JSON text has all that the pattern has: objects may hold more, lists must be the same length, 1 is not 1.0.
    A null or broken text has nothing."""
    wanted = json.loads(pattern)

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return t is not None and _holds(json.loads(t), wanted)
            except ValueError:
                return False

        return texts.map(one)

    return holds(document)
