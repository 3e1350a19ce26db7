"""Archive derivatives: pages, headers, records as bytes, archive files."""

from __future__ import annotations

import gzip
import hashlib
import json
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pliego.llm import queries, warc

HTML = '<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<b>two</b></p><script>x()</script><!-- no --><a href="/l?a=1&amp;b=2">link</a><br>end &eacute;</body></html>'


def archive(spark, *rows):
    return warc.responses(spark.createDataFrame(list(rows), "page_id long, url string, html string"))


class Slow(HTMLParser):
    """The same page by the standard parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.links, self.title, self.title_from, self.hidden = [], [], None, None, None

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in warc.HIDDEN:
            self.hidden = tag
            self.out.append(" ")
            return
        href = dict(attrs).get("href")
        if tag in warc.LINKS and href is not None:
            self.links.append(href)
        if tag == "title" and self.title is None:
            self.title_from = len(self.out)
        if tag in warc.BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        if tag == "title" and self.title is None and self.title_from is not None:
            self.title = " ".join(warc.unescaped("".join(self.out[self.title_from :])).split())
        if tag in warc.BREAKS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_comment(self, data):
        self.out.append(" " * (not self.hidden))

    def handle_data(self, data):
        self.out += [data] * (not self.hidden)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def slow_page(html):
    parser = Slow()
    parser.feed(html)
    parser.close()
    text = "\n".join(x for x in (" ".join(line.split()) for line in warc.unescaped("".join(parser.out)).split("\n")) if x)
    return parser.title, parser.links, text


def test_query_equals_slow_version(spark, sf):
    pages = {r["page_id"]: (r["url"], r["html"] or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op9_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        url, html = pages[r["page_id"]]
        title, links, text = slow_page(html)
        payload = "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        headers = [[":status", "HTTP/1.1 200 OK"], ["Content-Type", "text/html; charset=utf-8"], ["Content-Length", str(len(html.encode()))]]
        assert r["source_payload_digest"] == payload and json.loads(r["source_headers"]) == headers and r["target_uri"] == r["refers_to_target_uri"] == url
        if r["record_type"] == "conversion":
            assert r["block"] == text
        else:
            meta = json.loads(r["block"])
            assert (meta["title"], meta["links"], meta["http"], meta["refers-to"]) == (title, links, headers, r["refers_to"])
        assert r["content_length"] == len(r["block"].encode()) < r["record_bytes"] and r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()


def test_derivatives(spark):
    rows = warc.derive(archive(spark, (1, "http://x/", HTML), (2, None, None), (2, None, None))).collect()
    assert len(rows) == 6
    first = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    meta, text = first["metadata"], first["conversion"]
    assert text["block"] == "A & B\nOnetwo\nlink\nend é"
    got = json.loads(meta["block"])
    assert got["title"] == "A & B" and got["links"] == ["/l?a=1&b=2"] and got["refers-to"] == meta["refers_to"] == text["refers_to"]
    assert meta["record_id"] != text["record_id"] and all(r["block"] == "" for r in rows if r["page_id"] == 2 and r["record_type"] == "conversion")
    assert warc.derive(archive(spark, (1, "u", "x")).limit(0)).count() == 0


def test_odd_pages():
    assert warc.page('<a title="x > y" href=\'/q\'>t</a> 1 < 2 & 3 <b') == (None, ["/q"], "t 1 < 2 & 3 <b")
    assert warc.page("<TITLE>a\n b</TITLE><a data-href='no'>x</a><a href=/u>y</a><!-- <a href=z> -->") == ("a b", ["/u"], "a\nb\nxy")
    assert warc.page("a<script>never closed <p>") == (None, [], "a") and warc.page("") == (None, [], "")
    assert warc.page("&#" + "9" * 6000 + "; &amp;lt; &#x41;")[2] == "� &lt; A"


@pytest.mark.parametrize("part", ["<a ", "<title>", "<!--", "<script>", "<p ", "<a '", '<a ">', " ", "\n ", "&#", "</", "<a href=", "<a href=>"])
def test_time_is_linear(part):
    began = time.perf_counter()
    warc.page(part * (2_000_000 // len(part)))
    assert time.perf_counter() - began < 10


def test_header_lines():
    raw = "HTTP/1.1 200 OK\r\nContent-Type:text/html\r\nX-Long: one\r\n  two\r\nEmpty:\r\nno colon\r\nSet-Cookie: a: b\r\nSet-Cookie: c"
    wanted = [(":status", "HTTP/1.1 200 OK"), ("Content-Type", "text/html"), ("X-Long", "one two"), ("Empty", ""), ("", "no colon"), ("Set-Cookie", "a: b"), ("Set-Cookie", "c")]
    assert warc.header_lines(raw) == warc.header_lines(raw.replace("\r\n", "\n")) == wanted and warc.header_lines("") == []


def test_types_and_charsets():
    assert warc.text_of(b"\xe9", "text/html; charset=latin-1") == "é" and warc.text_of(b"\xe9", "") == "�" and warc.text_of(b"a", "text/plain; charset=none-such") == "a"
    assert warc.text_of(b"\x89PNG", "image/png") is None
    kinds = [r[1] for r in warc.derivatives("<i>", "u", "d", "HTTP/1.1 200 OK\nContent-Type: image/png", b"\x89PNG", None)]
    plain = list(warc.derivatives("<i>", "u", "d", "Content-Type: text/plain", b"1 < 2 <b>", None))
    assert kinds == ["metadata"] and plain[1][-1] == "1 < 2 <b>"


def record(kind, uri, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uri}>", "WARC-Target-URI": uri, "WARC-Date": "2023-05-01T10:00:00Z", "Content-Length": str(len(block)), **more}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_archive_files(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nContent-Type:text/html;charset=latin-1\r\n\r\n<title>T\xe9</title><a href='/x'>go</a>"
    image = b"HTTP/1.1 200 OK\nContent-Type: image/png\n\n\x89PNG\r\n\r\nmore"
    raw = [record("warcinfo", "w", b"software: x"), record("response", "http://a/", page, **{"WARC-Payload-Digest": "sha1:ABC"}), record("request", "http://a/", b"GET /"), record("response", "http://b/", image)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "two.warc").write_bytes(record("response", "http://c/", b"HTTP/1.0 404 No\r\n\r\n"))
    got = warc.read_archives(spark, [str(tmp_path / "one.warc.gz"), f"file://{tmp_path}/two.warc"]).withColumn("page_id", F.crc32(F.col("target_uri").cast("binary")))
    by_uri = {r["target_uri"]: r for r in got.collect()}
    assert bytes(by_uri["http://b/"]["payload"]) == b"\x89PNG\r\n\r\nmore" and by_uri["http://c/"]["http_headers"] == "HTTP/1.0 404 No" and len(by_uri) == 3
    files = warc.write_archives(warc.derive(got).repartition(2), str(tmp_path / "out")).collect()
    assert sum(r["n_records"] for r in files) == 5
    back = []
    for r in files:
        with gzip.open(r["path"]) as f:
            back += list(warc.records_of(f, r["path"]))
    fields, block = next((f, b) for f, b in back if f["warc-type"] == "conversion" and f["warc-target-uri"] == "http://a/")
    assert block.decode() == "Té\ngo" and fields["x-source-payload-digest"] == "sha1:ABC" and fields["warc-refers-to"] == "<urn:uuid:http://a/>" and fields["warc-refers-to-date"] == "2023-05-01T10:00:00Z"
    assert json.loads(fields["x-source-http-headers"]) == [[":status", "HTTP/1.1 200 OK"], ["Content-Type", "text/html;charset=latin-1"]]
    assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()


def test_broken_archives_are_errors():
    import io

    whole = record("response", "http://a/", b"HTTP/1.1 200 OK\r\n\r\nx")
    assert len(list(warc.records_of(io.BytesIO(whole), "n"))) == 1
    for bad in (whole[:-10], b"junk\n" + whole, whole.replace(b"Content-Length", b"Length")):
        with pytest.raises(ValueError, match="n: "):
            list(warc.records_of(io.BytesIO(bad), "n"))


def test_uris_break_no_record(spark):
    rows = warc.derive(archive(spark, (1, "http://x/\r\nWARC-Type: response", HTML)))
    raw = bytes(warc.as_warc(rows).where("record_type = 'conversion'").first()["warc"])
    (fields, block), = warc.records_of(__import__("io").BytesIO(raw), "n")
    assert fields["warc-type"] == "conversion" and fields["warc-target-uri"] == "http://x/%0D%0AWARC-Type: response" and block.decode().startswith("A & B")


def test_clashing_columns(spark):
    odd = archive(spark, (None, "u", "<p>x</p>" * 50_000), (1, "u", None)).selectExpr("*", "1 AS id", "'h' AS headers", "2 AS known", "'b' AS block", "'r' AS record_type")
    rows = warc.derive(odd).collect()
    assert len(rows) == 4 and max(len(r["block"]) for r in rows) == 99_999


PAGE = "<html><head><title>Naïve</title></head><body><p>Où est le café ?</p><a href='/b'>b</a></body></html>"


def chunks(data, size=7):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def bodies():
    """(name, header lines, payload) of one page, in every coding."""
    import zlib

    utf8, latin = PAGE.encode(), PAGE.encode("latin-1")
    declared = PAGE.replace("<head>", '<head><meta charset="iso-8859-1">').encode("latin-1")
    older = PAGE.replace("<head>", '<head><META http-equiv="Content-Type" content="text/html; charset=iso-8859-1">').encode("latin-1")
    raw = zlib.compressobj(wbits=-15)
    return [
        ("plain", "Content-Type: text/html", utf8), ("upper", "CONTENT-TYPE: TEXT/HTML; CHARSET=ISO-8859-1", latin), ("gzip", "Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(utf8)),
        ("members", "Content-Encoding: x-gzip", gzip.compress(utf8[:40]) + gzip.compress(utf8[40:])), ("deflate", "Content-Encoding: deflate", zlib.compress(utf8)), ("raw", "Content-Encoding: Deflate", raw.compress(utf8) + raw.flush()),
        ("chunked", "Transfer-Encoding: chunked", chunks(utf8)), ("both", "Transfer-Encoding: Chunked\r\nContent-Encoding: gzip", chunks(gzip.compress(utf8))), ("twice", "Content-Encoding: gzip, gzip", gzip.compress(gzip.compress(utf8))),
        ("transfer", "Transfer-Encoding: gzip, chunked", chunks(gzip.compress(utf8))), ("decoded before", "Transfer-Encoding: chunked\r\nContent-Encoding: gzip", utf8), ("meta", "Content-Type: Text/Html", declared), ("older meta", "Content-Type: text/html", older),
        ("mark", "Content-Type: text/html", b"\xef\xbb\xbf" + utf8), ("utf-16", "Server: x", PAGE.encode("utf-16")), ("xml", "Content-Type: application/xhtml+xml", b"<?xml version='1.0' encoding='iso-8859-1'?>" + latin), ("header first", "Content-Type: text/html; charset=utf-8", PAGE.replace("<head>", "<head><meta charset=latin-1>").encode()),
    ]


def test_coded_bodies_through_archives(spark, tmp_path):
    raw = [record("response", f"http://{i}/", f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + payload) for i, (_, head, payload) in enumerate(bodies())]
    (tmp_path / "all.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    rows = warc.derive(warc.read_archives(spark, [str(tmp_path / "all.warc.gz")]).withColumn("page_id", F.lit(1))).collect()
    texts = {r["target_uri"]: r["block"] for r in rows if r["record_type"] == "conversion"}
    metas = {r["target_uri"]: json.loads(r["block"]) for r in rows if r["record_type"] == "metadata"}
    for i, (name, _, payload) in enumerate(bodies()):
        assert texts[f"http://{i}/"] == "Naïve\nOù est le café ?\nb", name
        meta = metas[f"http://{i}/"]
        assert meta["title"] == "Naïve" and meta["links"] == ["/b"] and "undecoded" not in meta and meta["payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest(), name


def test_bodies_that_cant_be_decoded(monkeypatch):
    head = "HTTP/1.1 200 OK\nContent-Type: text/html\nContent-Encoding: br"
    (kind, meta), *rest = [(r[1], r[-1]) for r in warc.derivatives("<i>", "u", "d", head, b"\x8b\x02\x80", None)]
    assert kind == "metadata" and json.loads(meta)["undecoded"] == "br" and rest == []
    cut = gzip.compress(b"<p>" + bytes(range(65, 91)) * 500)[:-20]
    assert warc.body_of(cut, [("Content-Encoding", "gzip")])[0].startswith(b"<p>ABC")
    assert warc.body_of(b"5\r\nhello\r\nc\r\nwor", [("Transfer-Encoding", "chunked")]) == (b"hellowor", "")
    for junk in (b"", b"hello", b"5\nhello?", b"zz\r\n", b"-5\r\nhello\r\n", b"ffffffffffffffffff\r\nx"):
        assert warc.body_of(junk, [("Transfer-Encoding", "chunked")]) == (junk, "")
    monkeypatch.setattr(warc, "LARGEST", 1000)
    assert warc.body_of(gzip.compress(b"a" * 5000), [("Content-Encoding", "gzip")])[1] == "gzip"
    assert warc.text_of(b"abc", "text/html; charset=undefined") == "abc" and warc.text_of(b"<meta charset=utf-16>abc", "text/html") == "<meta charset=utf-16>abc"
    began = time.perf_counter()
    warc.text_of(b"<meta " * 400_000, "text/html")
    warc.dechunked(b"1\r\na\r\n" * 400_000)
    assert time.perf_counter() - began < 3
