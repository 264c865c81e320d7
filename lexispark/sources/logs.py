"""Readers: raw logs, declared charsets, embedded JSON, HTML."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def decode_bytes(c: Column, charset: str, reject: bool = False) -> Column:
    """Bytes in a declared charset; bytes that don't fit become U+FFFD or, with ``reject``, make the whole text null. Spark's own
    decode knows few charsets.
    """

    def one(b) -> str | None:
        try:
            return None if b is None else bytes(b).decode(charset, "strict" if reject else "replace")
        except UnicodeError:
            return None

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


def encode_text(c: Column, charset: str) -> Column:
    """Bytes of a text in a charset; characters that it lacks become question marks."""

    @F.pandas_udf(BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode(charset, "replace"))

    return run(c)


def read_lines(spark: SparkSession, path: str, charset: str = "UTF-8", max_bytes: int | None = None) -> DataFrame:
    """(path, line, text): lines of text files from 1, without byte order mark and carriage returns; a last empty line counts.

    Plain and gzip files, of any charset that Python knows. A file of more than ``max_bytes`` as stored is an error: a file is read as one row.
    """
    files = spark.read.text(path, wholetext=True)
    if max_bytes is not None and not files.filter(F.col("_metadata.file_size") > max_bytes).isEmpty():
        raise ValueError(f"a file is larger than {max_bytes} bytes")
    raw = files.select(F.input_file_name().alias("path"), F.col("value").cast("binary").alias("value"))
    text = F.col("value").cast("string") if charset.upper() in ("UTF-8", "UTF8") else decode_bytes(F.col("value"), charset)
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return raw.select("path", F.posexplode(F.split(clean, "\n", -1)).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def embedded_json(c: Column, marker: str, schema: str) -> Column:
    """The array between the first [ after a marker and the last ] of a text, parsed; null if there is none."""
    payload = F.regexp_extract(c, "\\Q" + marker + r"\E.*?(\[(?s:.*)\])", 1)
    return F.from_json(F.nullif(payload, F.lit("")), schema)


def html_text(c: Column) -> Column:
    """Text of HTML: scripts, styles and comments dropped, breaks and blocks as line breaks, tags stripped, six entities decoded."""
    for pattern, to in ((r"(?is)<(script|style)\b.*?</\1\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer)\b[^>]*>", "\n"), (r"<[^>]+>", "")):
        c = F.regexp_replace(c, pattern, to)
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(to))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


TAG = regex.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", regex.S)
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}
VOID = {"br", "img", "hr", "meta", "input", "link"}


def visible_lines(text: str, limit: int = 512) -> list[tuple[int, str, list[tuple[int, int, str]]]]:
    """(line, text, spans) of an HTML text; spans are code-point ranges with the style bold, red or blue."""
    out, buf, spans, stack = [], "", [], []

    def flush():
        nonlocal buf, spans
        body = buf.rstrip()
        if body:
            out.append((len(out) + 1, body, [(a, min(b, len(body)), s) for a, b, s in spans if a < len(body)]))
        buf, spans = "", []

    def add(chunk: str):
        nonlocal buf
        if any(s == "hidden" for _, ss in stack for s in ss):
            return
        chunk = regex.sub(r"\s+", " ", _html.unescape(chunk))
        if not buf:
            chunk = chunk.lstrip()
        elif buf.endswith(" "):
            chunk = chunk.lstrip(" ")
        start, buf = len(buf), buf + chunk
        if chunk.strip():
            spans.extend((start, len(buf), s) for s in sorted({s for _, ss in stack for s in ss}))

    at = 0
    for m in TAG.finditer(text):
        add(text[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name not in VOID:
            attrs = (m[3] or "").lower()
            styles = {k for k, p in (("red", r"(?<![-\w])color\s*[:=]\s*[\"']?(?:red|#f00|#ff0000)"), ("blue", r"(?<![-\w])color\s*[:=]\s*[\"']?(?:blue|#00f|#0000ff)"), ("hidden", r"display\s*:\s*none|\bhidden\b"), ("bold", r"font-weight\s*:\s*bold")) if regex.search(p, attrs)}
            if name in ("b", "strong"):
                styles.add("bold")
            if name in ("script", "style", "head"):
                styles.add("hidden")
            if len(stack) >= limit:
                raise ValueError("tags are nested too deeply")
            stack.append((name, styles))
    add(text[at:])
    flush()
    return out


def html_lines(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line, text, spans) of each page's visible lines; null pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, t, [{"start": a, "end": z, "style": s} for a, z, s in sp]) for k, h in zip(b[key], b[column]) if h is not None for n, t, sp in visible_lines(h)]
            yield pd.DataFrame(rows, columns=[key, "line", "text", "spans"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, column).mapInPandas(run, f"{key} {kind}, line int, text string, spans array<struct<start: int, end: int, style: string>>")


def segment_log(lines: DataFrame, file: str, header: str = r"^\d+ ?[:：]") -> DataFrame:
    """(file, line, text, category, post): each line as header, anchor, blank or body, with the last header line as post."""
    text = F.col("text")
    cat = F.when(F.trim(text) == "", "blank").when(text.rlike(header), "header").when(text.rlike(r"^>>\d+\s*$"), "anchor").otherwise("body")
    w = Window.partitionBy(file).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("category", cat)
    return x.withColumn("post", F.last(F.when(F.col("category") == "header", F.col("line")), ignorenulls=True).over(w))
