"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response gets a metadata record (title, language, character set, links, the source's
HTTP headers) and a conversion record (its text). Both name the response in WARC-Refers-To
and carry its target, date, payload digest and HTTP header lines, beside the digest of their
own block.
Identifiers are addresses of the content, so a rerun makes the same ones. Records are
written as WARC files by Spark's text sink, whose line separator is the mark that ends a
record, and so through any store and with its commit protocol.
"""

from __future__ import annotations

import html as markup
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Fixed values: (pattern, replacement) from HTML to text, with the entities after the fourth.
STEPS = (
    (r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|table|section|article|header|footer|nav|title)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
#: The target of a link; an attribute whose name only ends like it is none.
LINK = r"(?i)<a(?:\s[^>]*?)?\shref=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']*)"


def _decoded(text: str) -> str:
    """All named and numeric entities, decoded once; a no-break space as a space."""
    return markup.unescape(text.replace("&nbsp;", " ")) if "&" in text else text


@F.pandas_udf(StringType())
def decoded(texts: pd.Series) -> pd.Series:
    return texts.map(_decoded, na_action="ignore")


@F.pandas_udf(StringType())
def outlinks(targets: pd.Series) -> pd.Series:
    """A line for each target, in order."""
    line = lambda t: "outlink: " + re.sub(r"[\t\r\n]", "", _decoded(t.strip("\"'"))).strip() + "\r\n"
    return targets.map(lambda ts: "".join(map(line, ts)))


def _stepped(text: Column, steps) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def without_scripts(html: Column) -> Column:
    """A page without scripts, styles and comments."""
    return _stepped(html, STEPS[:2])


def visible_text(seen: Column) -> Column:
    """The text of what ``without_scripts`` leaves."""
    return _stepped(decoded(_stepped(seen, STEPS[2:4])), STEPS[4:])


def plain_text(html: Column) -> Column:
    return visible_text(without_scripts(html))


def record_id(*parts: Column) -> Column:
    """``<urn:uuid:...>`` from a digest of the parts; null parts count as empty."""
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p, F.lit("")) for p in parts)))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(
    pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Response records ``page_id, record_id, target_uri, warc_date, http_headers, payload``."""
    html = F.coalesce(html_col, F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
    )
    page = F.col(id_col).cast("long")
    return pages.select(
        page.alias("page_id"),
        record_id(F.lit("response"), page.cast("string"), F.col(url_col), html).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        head.alias("http_headers"),
        html.alias("payload"),
    )


def header_lines(headers: Column) -> Column:
    """The lines of an HTTP header that are not empty."""
    return F.filter(F.split(headers, r"\r\n"), lambda x: x != "")


def _header(
    kind: Column, own: Column, content: Column, block: Column, more: list[tuple[str, Column]], lines: Column | None = None
) -> Column:
    """The named lines of a record, those of its source last; a line whose value is null is left out."""
    named = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", F.col("warc_date")),
        ("WARC-Target-URI", F.col("target_uri")),
        *more,
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", content),
        ("Content-Length", F.octet_length(block).cast("string")),
        ("WARC-Source-HTTP-Header", F.lit(None).cast("string") if lines is None else lines),
    ]
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in named))


def response_records(source: DataFrame) -> DataFrame:
    """``header, block`` of the response records themselves, to be written beside the derivatives."""
    payload = F.coalesce("payload", F.lit(""))
    block = F.concat(F.coalesce("http_headers", F.lit("")), F.lit(END), payload)
    content = F.lit("application/http; msgtype=response")
    more = [("WARC-Payload-Digest", digest(payload))]
    return source.select(
        _header(F.lit("response"), F.col("record_id"), content, block, more).alias("header"), block.alias("block")
    )


def derive(source: DataFrame) -> DataFrame:
    """Two rows for each response: its ``metadata`` and its ``conversion`` record.

    Columns: ``page_id, record_id, warc_type, refers_to, target_uri, content_type,
    source_digest, block_digest, content_length, header, block``. ``source`` has the columns
    of ``responses``. Null payloads and headers count as empty, and a null target leaves its
    line out. Identifiers name contents, so repeated rows give repeated records of the same
    ones. Links in comments and scripts are none, as their text is no text. Pages of any length are converted whole; an empty table gives an empty result; other
    columns are ignored.
    """
    # Once for all that reads them below.
    html = F.coalesce("payload", F.lit(""))
    source = source.select(
        "page_id", "record_id", "target_uri", "warc_date", html.alias("html"), without_scripts(html).alias("seen"), digest(html).alias("source_digest"),
        header_lines(F.coalesce("http_headers", F.lit(""))).alias("lines"),
    )
    html, lines = F.col("html"), F.col("lines")
    targets = F.regexp_extract_all("seen", F.lit(LINK), F.lit(1))
    first = lambda pattern: F.regexp_extract(html, pattern, 1)
    named = [
        ("title", plain_text(first(r"(?is)<title[^>]*>(.*?)</title"))),
        ("lang", first(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([^\"'\s>]*)")),
        ("charset", first(r"(?i)<meta[^>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)")),
        ("outlinks", F.size(targets).cast("string")),
        ("source-payload-digest", F.col("source_digest")),
    ]
    # One line for each header of the source, so that none loses its form.
    headers = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-http-header: "), x, F.lit("\r\n"))), "")
    fields = F.concat(*(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in named), headers, outlinks(targets))
    made = [("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", visible_text(F.col("seen")))]
    records = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("content"), b.alias("block")) for k, c, b in made]
    rows = source.select("page_id", "record_id", "target_uri", "warc_date", "source_digest", "lines", F.explode(F.array(*records)).alias("r"))
    kind, content, block = F.col("r.kind"), F.col("r.content"), F.col("r.block")
    own, refers = record_id(kind, F.col("record_id"), digest(block)), F.col("record_id")
    source_lines = F.when(F.size("lines") > 0, F.array_join("lines", "\r\nWARC-Source-HTTP-Header: "))
    more = [
        ("WARC-Refers-To", refers),
        ("WARC-Source-Payload-Digest", F.col("source_digest")),
    ]
    return rows.select(
        "page_id",
        own.alias("record_id"),
        kind.alias("warc_type"),
        refers.alias("refers_to"),
        "target_uri",
        content.alias("content_type"),
        "source_digest",
        digest(block).alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        _header(kind, own, content, block, more, source_lines).alias("header"),
        block.alias("block"),
    )


def write_records(records: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write ``header, block`` rows as WARC files of at most ``rows_per_file`` records."""
    whole = F.concat("header", F.lit(END), "block")
    records.select(whole.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", rows_per_file).option(
        "compression", "gzip"
    ).text(path)
