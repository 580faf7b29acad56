"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives one ``conversion`` record with its text and one
``metadata`` record with what the page says about itself. Both name the
response they come from, keep its HTTP headers and digests, and name each
other. Pages are read by a small function, and all else is column expressions
on one row: nothing is shuffled.
"""

from __future__ import annotations

import html as html_entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Digits of base 32 as Java writes them, and those of RFC 4648.
_JAVA32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What a page says to programs only, and where each kind of it ends.
_UNSEEN = re.compile(r"<(?:!--|(script|style|noscript|title)\b)", re.ASCII | re.IGNORECASE)
_ENDS = {
    kind: re.compile(f"</{kind}[^>]*>" if kind else "-->", re.IGNORECASE)
    for kind in ("", "script", "style", "noscript", "title")
}
#: Stands for a line end of an element until white space is set right.
_END = "\u0001"
#: Elements that begin and end a line.
_LINE = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form"
    r"|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:[ \t\r\n/][^>]*)?>",
    re.ASCII | re.IGNORECASE,
)
_TAG = re.compile("<[^>]*>")
_SPACES = re.compile("[ \t\r\n]{2,}|[\t\r\n]")
_LINE_ENDS = re.compile(f" ?{_END}[ {_END}]*")
_TITLE, _TITLE_END = re.compile("<title[^>]*>", re.IGNORECASE), re.compile("</title", re.IGNORECASE)
_HTML = re.compile("<html[^>]*>", re.IGNORECASE)
_LANG = re.compile("[ \t\r\n]lang=[\"']?([a-z0-9-]+)", re.ASCII | re.IGNORECASE)
_ANCHOR = re.compile("<a[ \t\r\n]", re.IGNORECASE)
#: An attribute: its name, and its value in double, single or no quotes.
_ATTRIBUTE = re.compile(
    r"[ \t\r\n/]*+([^= \t\r\n/>]++)"
    r"(?:[ \t\r\n]*+=[ \t\r\n]*+(\"[^\"]*+\"|'[^']*+'|[^ \t\r\n\"'>][^ \t\r\n>]*+|))?"
)
#: An entity with its semicolon; of others, as in addresses, none is meant.
_ENTITY = re.compile("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


# --- Pages -------------------------------------------------------------------
#
# Every function goes once from left to right: what is searched for and not
# found is not searched for again, and tags are sought before the last ">" only,
# so that no page takes longer than its length, however it is broken.


def decode(text: str) -> str:
    """Named and numeric entities as characters, unknown ones as they are; a hard space is a space."""
    if "&" not in text:
        return text
    return _ENTITY.sub(
        lambda m: " " if m[0] == "&nbsp;" else html_entities.unescape(m[0]), text
    )


def visible(page: str) -> str:
    """The page without comments, scripts, styles, their likes and the title, a space for each."""
    out, start, at, dead = [], 0, 0, set()
    while found := _UNSEEN.search(page, at):
        kind = (found[1] or "").lower()
        end = None if kind in dead else _ENDS[kind].search(page, found.end())
        if end is None:
            dead.add(kind)
            at = found.end()
        else:
            out += (page[start : found.start()], " ")
            start = at = end.end()
    return "".join([*out, page[start:]])


def plain_text(page: str) -> str:
    """The visible text, a line for each block, blank lines left out.

    White space within a line is one space. A character U+0001 ends a line.
    """
    last = page.rfind(">") + 1
    text = _TAG.sub("", _LINE.sub(_END, visible(page[:last])))
    text = _SPACES.sub(" ", decode(text + page[last:]))
    return _LINE_ENDS.sub("\n", text).strip(" \n")


def title(page: str) -> str:
    begin = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = begin and _TITLE_END.search(page, begin.end())
    return decode(page[begin.end() : end.start()]).strip(" \t\r\n") if end else ""


def language(page: str) -> str:
    """The ``lang`` attribute of the first ``html`` element that has one."""
    for tag in _HTML.finditer(page, 0, page.rfind(">") + 1):
        if given := _LANG.findall(tag[0]):
            return given[-1]
    return ""


def links(page: str) -> list[str]:
    """Addresses of the ``a`` elements, each once, in order."""
    found: dict[str, None] = {}
    at = 0
    while anchor := _ANCHOR.search(page, at):
        at = anchor.end()
        href = None
        while attribute := _ATTRIBUTE.match(page, at):
            at = attribute.end()
            if href is None and attribute[1].lower() == "href" and attribute[2]:
                value = attribute[2]
                href = value[1:-1] if value[0] in "\"'" else value
        if href is not None:
            found[decode(href)] = None
    return list(found)


_PAGE = "text string, title string, lang string, links array<string>"


def _read(pages: pd.Series) -> pd.DataFrame:
    rows = [(plain_text(p), title(p), language(p), links(p)) for p in pages]
    return pd.DataFrame(rows, columns=["text", "title", "lang", "links"])


# --- Records -----------------------------------------------------------------


def sha1_digest(data: Column) -> Column:
    """``sha1:`` and the digest in base 32, as WARC files have it."""
    hexed = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), _JAVA32, _RFC32))


def record_id(name: Column) -> Column:
    """A URN in the form of a version 5 UUID, made from ``name`` alone."""
    h = F.sha1(name)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12), F.lit(">"),
    )


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Pages as responses: record_id, target_uri, date, http_headers, payload.

    A crawl that kept the bodies only: the headers are those that follow from
    them. The id is made from page id, URL and body, with nulls marked.
    """
    html = F.coalesce("html", F.lit(""))
    null = F.lit("\u0000")
    named = F.concat_ws(
        "\u0001",
        F.coalesce(F.col("page_id").cast("string"), null),
        F.coalesce("url", null),
        F.sha1(html),
    )
    return pages.select(
        "page_id",
        record_id(named).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
            F.lit("Content-Length: "),
            F.octet_length(html).cast("string"),
        ).alias("http_headers"),
        html.alias("payload"),
    )


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    clean = F.regexp_replace(value, "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _fields(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[_field(name, value) for name, value in pairs])


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for every response, each a row with its header and block.

    ``responses``: record_id, target_uri, date, http_headers and payload
    (string). Other columns, except those of the result, are carried along.
    The result has warc_type, record_id, refers_to, refers_to_uri,
    refers_to_date, concurrent_to, source_headers, source_digest, block_digest,
    content_length, header and block.

    A null or empty payload gives an empty text and the digest of no bytes. A
    null address is left out of the headers. Records of one response have the
    same ids in every run; repeated responses give repeated records.
    """
    taken = ("target_uri", "date", "http_headers", "payload")
    made = (
        "warc_type record_id refers_to refers_to_uri refers_to_date concurrent_to source_headers "
        "source_digest block_digest content_length header block kinds kind twin uri text _page _headers"
    ).split()
    carried = [c for c in responses.columns if c not in (*taken, *made)]
    payload = F.coalesce("payload", F.lit(""))
    made_of = responses.withColumn("_page", F.pandas_udf(_read, _PAGE)(payload))
    source = made_of.select(
        *carried,
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("refers_to_uri"),
        F.col("date").alias("refers_to_date"),
        F.col("http_headers").alias("source_headers"),
        sha1_digest(payload).alias("source_digest"),
        *[F.col(f"_page.{name}").alias(name) for name in ("text", "title", "lang", "links")],
    )
    outlinks = F.array_join(
        F.transform("links", lambda x: _field("outlink", F.concat(x, F.lit(" L a/@href")))), ""
    )
    http = F.array_join(
        F.transform(
            F.expr("slice(_headers, 2, greatest(size(_headers) - 1, 0))"),
            lambda x: F.concat(F.lit("http-header: "), x, F.lit(CRLF)),
        ),
        "",
    )
    metadata = F.concat(
        _fields(
            ("sourceRecord", F.col("refers_to")),
            ("sourceDigest", F.col("source_digest")),
            ("title", F.when(F.col("title") != "", F.col("title"))),
            ("language", F.when(F.col("lang") != "", F.col("lang"))),
            ("textLength", F.octet_length("text").cast("string")),
        ),
        F.coalesce(http, F.lit("")),
        F.coalesce(outlinks, F.lit("")),
    )
    source = source.withColumn("_headers", F.split("source_headers", "\r?\n"))
    kinds = ("conversion", "metadata")
    ids = [record_id(F.concat_ws("\u0001", F.lit(kind), "refers_to")) for kind in kinds]
    blocks = (F.col("text"), metadata)
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("warc_type"),
                ids[i].alias("record_id"),
                ids[1 - i].alias("concurrent_to"),
                blocks[i].alias("block"),
            )
            for i, kind in enumerate(kinds)
        ]
    )
    kept = ("refers_to", "refers_to_uri", "refers_to_date", "source_headers", "source_digest")
    out = source.select(*carried, *kept, F.inline(rows))
    out = out.withColumn("block_digest", sha1_digest(F.col("block")))
    out = out.withColumn("content_length", F.octet_length("block").cast("long"))
    kind_of = F.when(F.col("warc_type") == "conversion", "text/plain; charset=utf-8").otherwise(
        "application/warc-fields"
    )
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _fields(
            ("WARC-Type", F.col("warc_type")),
            ("WARC-Record-ID", F.col("record_id")),
            ("WARC-Date", F.col("refers_to_date")),
            ("WARC-Target-URI", F.col("refers_to_uri")),
            ("WARC-Refers-To", F.col("refers_to")),
            ("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
            ("WARC-Refers-To-Date", F.col("refers_to_date")),
            ("WARC-Concurrent-To", F.col("concurrent_to")),
            ("WARC-Source-Payload-Digest", F.col("source_digest")),
            ("WARC-Block-Digest", F.col("block_digest")),
            ("Content-Type", kind_of),
            ("Content-Length", F.col("content_length").cast("string")),
        ),
    )
    return out.withColumn("header", header).select(
        *carried, "warc_type", "record_id", *kept, "concurrent_to", "block_digest",
        "content_length", "header", "block",
    )


def write(records: DataFrame, path: str) -> None:
    """WARC files of the records, one for each partition."""
    record = F.concat("header", F.lit(CRLF), "block")
    records.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).text(path)
