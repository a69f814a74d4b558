"""Text of EPUB books: an archive of pages in the order of its spine."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_BLOCKS = {"p", "div", "li", "br", "tr", "title", "section", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def page_words(page: str) -> str:
    own = _Words()
    own.feed(page)
    lines = (" ".join(x.split()) for x in "".join(own.out).split("\n"))
    return "\n".join(x for x in lines if x)


def pages_of(archive: bytes, most: int = 64 << 20) -> list[str]:
    """The pages of an EPUB in reading order; none of what is no EPUB. A book that unpacks to more than `most` bytes is an
    error: archives come from anywhere."""
    try:
        book = zipfile.ZipFile(io.BytesIO(archive))
        root = ET.fromstring(book.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        package = ET.fromstring(book.read(root))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError):
        return []
    if sum(i.file_size for i in book.infolist()) > most:
        raise ValueError(f"the book unpacks to more than {most} bytes")
    names = {i.get("id"): i.get("href") for i in package.iterfind(".//{*}manifest/{*}item")}
    out = []
    for ref in package.iterfind(".//{*}spine/{*}itemref"):
        at = posixpath.normpath(posixpath.join(posixpath.dirname(root), names.get(ref.get("idref"), "")))
        if at in book.namelist():
            out.append(page_words(book.read(at).decode("utf-8", "replace")))
    return out


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of the books at path, page by page."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, t) for p, content in zip(pdf["path"], pdf["content"]) for i, t in enumerate(pages_of(bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page long, text string")
