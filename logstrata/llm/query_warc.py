"""op1: derivative records of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import warc
from logstrata.llm.common import table

NAME = "op1_warc_derivatives"
DATE = "2024-01-01T00:00:00Z"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), DATE))


def _sha1(data: str) -> str:
    """SQL of a digest in base 32."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)"
    digit = digit.replace("v >>", f"('0x' || substr(sha1({data}), 5 * (i // 4) + 1, 5))::BIGINT >>")
    return f"'sha1:' || list_reduce(list_transform(range(32), lambda i: {digit}), lambda a, b: a || b)"


def _urn(name: str) -> str:
    h = f"sha1({name})"
    return (
        f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3)"
        f" || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
        f" || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The entities of the given pages and the basic ones; the ampersand comes last.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "\u00a9"),
    ("&middot;", "\u00b7"),
    ("&amp;", "&"),
)
#: The page patterns of the operator, as one regular expression each.
UNSEEN = (
    r"<(?:!--(?s:.*?)-->|(?i:script)\b(?s:.*?)</(?i:script)[^>]*>|(?i:style)\b(?s:.*?)</(?i:style)[^>]*>"
    r"|(?i:noscript)\b(?s:.*?)</(?i:noscript)[^>]*>|(?i:title)\b(?s:.*?)</(?i:title)[^>]*>)"
)
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r"(?i)<html[^>]*[ \t\r\n]lang=[\"']?([a-z0-9-]+)"
LINK = r"(?i)<a[ \t\r\n][^>]*?href=\"([^\"]*)\""


def _decode(text: str) -> str:
    out = text
    for entity, character in ENTITIES:
        out = f"replace({out}, {_quoted(entity)}, {_quoted(character)})"
    return out


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_quoted(pattern)}, {by}, 'g')"


_TEXT = _sub(_sub("html", UNSEEN, "' '"), f"(?i){warc._LINE.pattern}", "chr(1)")
_TEXT = _decode(_sub(_TEXT, "<[^>]*>", "''"))
_TEXT = _sub(_sub(_TEXT, "[ \t\r\n]{2,}|[\t\r\n]", "' '"), f" ?{warc._END}[ {warc._END}]*", "chr(10)")
_TEXT = f"trim({_TEXT}, ' ' || chr(10))"
_WS = "' ' || chr(9) || chr(13) || chr(10)"
_NL = "chr(13) || chr(10)"


def _line(name: str, value: str) -> str:
    return f"coalesce('{name}: ' || {_sub(value, f'[{chr(13)}{chr(10)}]+', chr(39) + ' ' + chr(39))} || {_NL}, '')"


_HEADER = " || ".join(
    ["'WARC/1.1' || " + _NL]
    + [
        _line(name, value)
        for name, value in (
            ("WARC-Type", "warc_type"),
            ("WARC-Record-ID", "record_id"),
            ("WARC-Date", "refers_to_date"),
            ("WARC-Target-URI", "refers_to_uri"),
            ("WARC-Refers-To", "refers_to"),
            ("WARC-Refers-To-Target-URI", "refers_to_uri"),
            ("WARC-Refers-To-Date", "refers_to_date"),
            ("WARC-Concurrent-To", "concurrent_to"),
            ("WARC-Source-Payload-Digest", "source_digest"),
            ("WARC-Block-Digest", "block_digest"),
            (
                "Content-Type",
                "CASE warc_type WHEN 'conversion' THEN 'text/plain; charset=utf-8' "
                "ELSE 'application/warc-fields' END",
            ),
            ("Content-Length", "content_length::VARCHAR"),
        )
    ]
)

_LINKS = (
    f"list_transform(list_distinct_kept, lambda x: {_line('outlink', _decode('x') + chr(32) + '|| ' + chr(39) + ' L a/@href' + chr(39))})"
)

SQL = f"""
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html,
        coalesce(page_id::VARCHAR, chr(0)) || chr(1) || coalesce(url, chr(0)) || chr(1)
            || sha1(coalesce(html, '')) AS named
    FROM pages
),
s AS (
    SELECT page_id, {_urn('named')} AS refers_to, url AS refers_to_uri, '{DATE}' AS refers_to_date,
        'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL}
            || 'Content-Length: ' || strlen(html) AS source_headers,
        {_sha1('html')} AS source_digest, {_TEXT} AS text,
        trim({_decode(f"regexp_extract(html, {_quoted(TITLE)}, 1)")}, {_WS}) AS title,
        regexp_extract(html, {_quoted(LANG)}, 1) AS lang,
        regexp_extract_all(html, {_quoted(LINK)}, 1) AS links
    FROM p
),
l AS (
    SELECT *, list_filter(links, lambda x, i: list_position(links, x) = i) AS list_distinct_kept
    FROM s
),
m AS (
    SELECT *, {_line('sourceRecord', 'refers_to')} || {_line('sourceDigest', 'source_digest')}
        || {_line('title', "nullif(title, '')")} || {_line('language', "nullif(lang, '')")}
        || {_line('textLength', 'strlen(text)::VARCHAR')}
        || 'http-header: Content-Type: text/html; charset=utf-8' || {_NL}
        || 'http-header: ' || split_part(source_headers, {_NL}, 3) || {_NL}
        || array_to_string({_LINKS}, '') AS fields,
        {_urn("'conversion' || chr(1) || refers_to")} AS text_id,
        {_urn("'metadata' || chr(1) || refers_to")} AS fields_id
    FROM l
),
r AS (
    SELECT page_id, 'conversion' AS warc_type, text_id AS record_id, refers_to, refers_to_uri,
        refers_to_date, source_headers, source_digest, fields_id AS concurrent_to, text AS block
    FROM m
    UNION ALL
    SELECT page_id, 'metadata', fields_id, refers_to, refers_to_uri, refers_to_date,
        source_headers, source_digest, text_id, fields FROM m
),
d AS (
    SELECT *, {_sha1('block')} AS block_digest, strlen(block)::BIGINT AS content_length FROM r
)
SELECT *, {_HEADER} AS header FROM d
"""
