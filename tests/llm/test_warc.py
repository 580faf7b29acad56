"""WARC derivatives: links, digests, text and files."""

import base64
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from logstrata.llm import warc

SCHEMA = "page_id long, url string, html string, block string, header string, text string"
HTML = (
    '<!DOCTYPE html><html lang="de"><head><title>A &amp; B\n c</title><style>p{}</style>'
    "<script>var t='</p>';</script></head><body><!-- no --><p>One &lt;x&gt;&nbsp;two</p>"
    '<div>three<br/>four <b>bold</b></div><a class="k" href="/p?a=1&amp;b=2">l</a><a href="/p?a=1&amp;b=2">m</a>'
    "<ul><li>é</li></ul></body></html>"
)


def made(spark, rows):
    pages = spark.createDataFrame([(*r, "b", "h", "t") for r in rows], SCHEMA)
    return warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z")).collect()


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_linked_records(spark):
    rows = made(spark, [(1, "http://a/x", HTML), (2, None, None), (2, None, None), (None, "u", "")])
    assert len(rows) == 8
    by = {(r["page_id"], r["warc_type"]): r for r in rows}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text["block"] == "One <x> two\nthree\nfour bold\nlm\né"
    assert text["concurrent_to"] == meta["record_id"] and meta["concurrent_to"] == text["record_id"]
    assert text["refers_to"] == meta["refers_to"] and len({r["record_id"] for r in rows}) == 6
    for r in rows:
        assert r["block_digest"] == sha1(r["block"])
        assert r["content_length"] == len(r["block"].encode())
        assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["header"]
        assert ("WARC-Target-URI" in r["header"]) == (r["refers_to_uri"] is not None)
    assert text["source_digest"] == sha1(HTML)
    lines = meta["block"].split("\r\n")
    assert "title: A & B  c" in lines and "language: de" in lines
    assert lines.count("outlink: /p?a=1&b=2 L a/@href") == 1
    assert "http-header: Content-Type: text/html; charset=utf-8" in lines
    assert by[2, "conversion"]["block"] == "" and by[2, "conversion"]["source_digest"] == sha1("")


def test_long_page_and_empty_table(spark):
    html = "<p>" + "x < y " * 200_000 + "<!-- never closed " + "<script>" * 50
    assert len(made(spark, [(1, "u", html)])) == 2
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.derivatives(warc.responses(pages, "d")).count() == 0


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", HTML)], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"))
    warc.write(records.coalesce(1), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    found = 0
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1") and fields["WARC-Block-Digest"] == sha1(rest[:size].decode())
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, found = rest[size + 4 :], found + 1
    assert found == 2


def test_links_in_all_quotings(spark):
    many = " ".join(f"data-a{i}='{i}'" for i in range(2000))
    html = (
        "<a href='/single?q=\"x\"'>1</a><A class=k HREF=/bare>2</A><a href = \"/spaced\">3</a><a\nhref=/n/ id=x>4</a>"
        "<a title='no href=/title' href=\"/after\">5</a><a title=don't href='/odd'>6</a><a data-href='/data'>7</a>"
        f"<a {many} href=/many>8</a><a href=''>9</a><a name=x>10</a><a href=/bare>11</a><a title=\"a>b\" href='/gt'>12</a>"
    )
    (meta,) = [r for r in made(spark, [(1, "u", html)]) if r["warc_type"] == "metadata"]
    links = [x[9:-10] for x in meta["block"].split("\r\n") if x.startswith("outlink: ")]
    assert links == ['/single?q="x"', "/bare", "/spaced", "/n/", "/after", "/odd", "/many", "", "/gt"]


def test_entities_are_decoded(spark):
    html = "<p>&copy; 2024 &middot; it&#8217;s &eacute;t&#xE9; &ndash; a&nbsp;b &amp;lt; &unknown; &copy=1 &</p>"
    html += '<a href="/x?a=1&copy=2&amp;b=3&eacute;">l</a>'
    rows = {r["warc_type"]: r for r in made(spark, [(1, "u", html)])}
    assert rows["conversion"]["block"].startswith("© 2024 · it’s été – a b &lt; &unknown; &copy=1 &")
    assert "outlink: /x?a=1&copy=2&b=3é L a/@href" in rows["metadata"]["block"]


BROKEN = ["<!--", "<script>", "<style", "<title>", "</title", "<a ", '<a x="', "<a href=", "<html ", "<", "<div ", "&", "</script"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_pages_take_time_in_proportion(part):
    for whole in (part * (2_000_000 // len(part)), part * (1_000_000 // len(part)) + ">", f"{part} >" * 200_000):
        began = time.perf_counter()
        warc.plain_text(whole), warc.title(whole), warc.language(whole), warc.links(whole)
        assert time.perf_counter() - began < 10


def test_many_headers_stay(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    lines = "".join(f"X-{i}: {i}\r\n" for i in range(3000))
    made_of = warc.responses(pages, "d").withColumn("http_headers", F.lit("HTTP/1.1 200 OK\r\n" + lines[:-2]))
    rows = {r["warc_type"]: r for r in warc.derivatives(made_of).collect()}
    assert rows["metadata"]["block"].count("http-header: ") == 3000
