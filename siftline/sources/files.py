"""Scans of uploaded files: whitelist, content checks, text extraction."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted extensions and limits of one upload.
EXTENSIONS = (".pdf", ".docx", ".md", ".txt")
MAX_FILES = 10
MAX_BYTES = 25 * 1024 * 1024
#: Tags whose start begins a new paragraph.
BLOCK_TAGS = frozenset("p div section article h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre hr".split())


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))


def accepted(filename: Column, size: Column) -> Column:
    """Null for an acceptable file, else the reason."""
    return F.when(~extension(filename).isin(*EXTENSIONS), "unsupported extension").when(size > MAX_BYTES, "too large")


def sniff_text(text: Column) -> Column:
    """Content check of text files on decoded text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty").when(F.contains(text, F.lit("\0")), "contains NUL")


def sniff(ext: Column, content: Column) -> Column:
    """Null if the bytes fit the extension, else the reason. ZIP contents are checked by ``docx_member``."""
    head = F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^[\s\x00]+", "")
    pdf = F.when(~head.startswith("%PDF-"), "not a PDF")
    docx = F.when(~head.startswith("PK"), "not a DOCX").when(~docx_member(content), "not a DOCX")
    plain = F.when(F.contains(F.decode(content, "ISO-8859-1"), F.lit("\0")), "contains NUL").when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty").otherwise(F.when(ext == ".pdf", pdf).when(ext == ".docx", docx).when(ext.isin(".md", ".txt"), plain).otherwise("unsupported extension"))


@F.pandas_udf(T.BooleanType())
def docx_member(content: pd.Series) -> pd.Series:
    def has(b: bytes | None) -> bool:
        try:
            return b is not None and "word/document.xml" in zipfile.ZipFile(io.BytesIO(b)).namelist()
        except zipfile.BadZipFile:
            return False

    return content.map(has)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.out.append("\n\n" if tag in BLOCK_TAGS else "\n" if tag == "br" else "")

    def handle_data(self, data):
        self.out.append(data)


def html_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


def markdown_text(text: str | None) -> str | None:
    """Headings, lists, emphasis, links and code of Markdown as plain text."""
    if text is None:
        return None
    text = re.sub(r"^```.*$", "", text, flags=re.MULTILINE)
    text = re.sub(r"^\s{0,3}(#{1,6}|[-*+]|\d+\.|>)\s+", "", text, flags=re.MULTILINE)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(\*\*|__|`)(.+?)\1", r"\2", text)
    text = re.sub(r"(?<!\w)[*_](\S(?:.*?\S)?)[*_](?!\w)", r"\1", text)
    return html_text(text)


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs, then tables with cells parted by ``|``, parted by blank lines."""
    if content is None:
        return None
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    parts = [said(p) for p in body.findall(f"{w}p")]
    for table in body.findall(f"{w}tbl"):
        parts += [" | ".join(said(c).strip() for c in row.findall(f"{w}tc")) for row in table.findall(f"{w}tr")]
    return "\n\n".join(p for p in parts if p.strip())


def _column(f, c: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(f)

    return run(c)


def html_column(c: Column) -> Column:
    return _column(html_text, c)


def markdown_column(c: Column) -> Column:
    return _column(markdown_text, c)


def docx_column(c: Column) -> Column:
    return _column(docx_text, c)


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page, where a PDF reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with extension, sha256 and the reason to refuse them."""
    df = spark.read.format("binaryFile").load(path)
    ext = extension(F.col("path"))
    return df.select("path", "length", ext.alias("extension"), F.sha2("content", 256).alias("sha256"), F.coalesce(accepted(F.col("path"), F.col("length")), sniff(ext, F.col("content"))).alias("reason"), "content")


def golden_lines(spark: SparkSession, path: str) -> DataFrame:
    """Golden-set lines with 1-based line numbers and the errors of each; blank lines are skipped."""
    from siftline.schemas import schema

    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value")).where(F.trim("value") != "")
    parsed = raw.select((F.col("at") + 1).alias("line"), "value", F.from_json("value", schema("golden_line"), {"mode": "PERMISSIVE"}).alias("q"), F.expr("try_parse_json(value) IS NOT NULL").alias("json"))
    return parsed.select("line", "q.*", golden_errors(F.col("line"), F.col("json"), F.col("q.question"), F.col("q.ground_truth"), F.col("q.relevant_chunk_ids")).alias("errors"))


def golden_errors(line: Column, json: Column, question: Column, truth: Column, ids: Column) -> Column:
    def bad(when: Column, field: str) -> Column:
        return F.when(when, F.concat(F.lit("line "), line.cast("string"), F.lit(f".{field}")))

    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.array_compact(F.array(bad(~json, "json"), bad((size(question) < 3) | (size(question) > 2000), "question"), bad((size(truth) < 1) | (size(truth) > 5000), "ground_truth"), bad(F.coalesce(F.size(ids), F.lit(0)) > 20, "relevant_chunk_ids")))
