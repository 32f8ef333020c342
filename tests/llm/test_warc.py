import gzip
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from seatward.llm.warc import (
    archive, build, derivatives, derive, digest, http_parts, language_of, links_of, members, parse, plain_text, read_derivatives, response, response_members, title_of,
)

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B
 c</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><!-- no --><p>One<br>two &lt;3&gt;</p>
<a class=x href="/l?a=1&amp;b=2">link</a><A HREF='q'>q</A><ul><li>x</li><li>y</li></ul>a < b</body></html>"""


def test_text_and_metadata():
    assert plain_text(PAGE).split("\n") == ["A & B", "c", "One", "two <3>", "linkq", "x", "y", "a < b"]
    source, block = parse(response(7, "http://e.x/é", PAGE))
    about, text = (parse(r) for r in derivatives(response(7, "http://e.x/é", PAGE)))
    assert about[0]["warc-type"] == "metadata" and text[0]["warc-type"] == "conversion"
    for headers, body in (about, text):
        assert headers["warc-refers-to"] == source["warc-record-id"] and headers["warc-target-uri"] == "http://e.x/é"
        assert headers["warc-date"] == source["warc-date"] and headers["warc-block-digest"] == digest(body)
        assert int(headers["content-length"]) == len(body)
    assert about[0]["warc-concurrent-to"] == text[0]["warc-record-id"] and text[0]["warc-concurrent-to"] == about[0]["warc-record-id"]
    fields = about[1].decode().split("\r\n")
    assert "title: A & B c" in fields and "language: fr" in fields and "link: /l?a=1&b=2" in fields and "link: q" in fields
    assert f"source-payload-digest: {source['warc-payload-digest']}" in fields and "source-digest-valid: true" in fields
    assert "http-content-type: text/html; charset=utf-8" in fields and "status: HTTP/1.1 200 OK" in fields
    assert http_parts(block)[2] == PAGE.encode() and text[1].decode() == plain_text(PAGE)


def test_odd_records():
    assert derivatives(build([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:x>")], b"GET / HTTP/1.1\r\n\r\n")) == []
    latin = b"HTTP/1.1 404 Not\r\ncontent-type: text/html; charset=latin-1\r\n\r\n<p>\xe9</p>"
    record = build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>"), ("WARC-Payload-Digest", "sha1:WRONG")], latin)
    about, text = (parse(r) for r in derivatives(record))
    assert text[1].decode() == "é" and "source-digest-valid: false" in about[1].decode() and "warc-target-uri" not in text[0]
    headless = parse(derivatives(build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:z>")], b"no end of headers"))[1])
    assert headless[1] == b""
    assert plain_text("<script>never closed") == "" and plain_text("<!-- never closed") == "" and plain_text("x" * 200_000) == "x" * 200_000
    assert parse(build([("A", "b\r\nInjected: c")], b"\r\n\r\n"))[0] == {"a": "b Injected: c", "content-length": "4"}


def test_on_tables(spark):
    rows = [(1, "http://a/1", PAGE), (1, "http://a/1", PAGE), (2, None, "<p>x</p>"), (3, "http://a/3", None), (None, "http://a/4", ""), (5, "http://a/5", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("member", F.lit("clash")).repartition(3)
    responses = members(response_members(pages), "t", file_bytes=2000)
    archive = members(derive(responses), "t")
    got = read_derivatives(archive).collect()
    assert len(got) == 12 and all((r["target_uri"] is None) == (r["page_id"] == 2) for r in got)
    texts = sorted((str(r["page_id"]), len(r["block"])) for r in got if r["warc_type"] == "conversion")
    assert texts == [("1", len(plain_text(PAGE)))] * 2 + [("2", 1), ("3", 0), ("5", 100_000), ("None", 0)]
    # Members one after the other make the file that offsets and lengths describe.
    for name in {r["file"] for r in responses.collect()}:
        parts = responses.where(F.col("file") == name).orderBy("offset").collect()
        data = b"".join(bytes(p["member"]) for p in parts)
        assert all(data[p["offset"] : p["offset"] + p["length"]] == bytes(p["member"]) for p in parts)
        assert gzip.decompress(data) == b"".join(gzip.decompress(bytes(p["member"])) for p in parts)
    assert read_derivatives(derive(response_members(pages.limit(0)))).count() == 0


BROKEN = ["<a ", "<title>", "<script ", "<script>", "<!--", "<p ", "</title ", "<a href=", "<a href='x", "<html lang", "<", "</script", "<title></title ", "<a href  ", "x<style><a>", "&amp", "<a <title <p "]


@pytest.mark.parametrize("piece", BROKEN)
@pytest.mark.parametrize("end", ["", ">", "-->", "</script>"])
def test_broken_pages_take_time_by_length(piece, end):
    page = piece * (900_000 // len(piece)) + end
    start = time.process_time()
    plain_text(page), title_of(page), links_of(page), language_of(page)
    assert time.process_time() - start < 3


BLOCKS = "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article nav header footer blockquote pre hr title body head main aside".split()


class Reader(HTMLParser):
    """The same from the standard parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.language, self.title, self.titles, self.off = [], [], None, None, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.off.append(tag)
            self.out.append(" ")
        if self.off:
            return
        self.out.append("\n" if tag in BLOCKS else "")
        values = dict(reversed(attrs))
        if tag == "a" and "href" in values:
            self.links.append(values["href"])
        if tag == "html" and self.language is None:
            self.language = values.get("lang")
        if tag == "title" and self.title is None:
            self.title, self.titles = "", 1

    def handle_endtag(self, tag):
        if self.off:
            self.off = [] if tag == self.off[0] else self.off
            return
        self.out.append("\n" if tag in BLOCKS else "")
        self.titles = 0 if tag == "title" else self.titles

    def handle_comment(self, data):
        self.out.append("" if self.off else " ")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)
            self.title = self.title + data if self.titles else self.title


def page_of(rng, depth=0):
    word = lambda: rng.choice(["one", "two &amp; three", "é", "4 &lt; 5", "&eacute;", "a  b\nc", "x"])
    parts = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(9)
        if kind < 3 or depth > 3:
            parts.append(word())
        elif kind == 3:
            parts.append(f"<!-- {word()} <p>no</p> -->")
        elif kind == 4:
            parts.append(f"<{rng.choice(['script', 'STYLE'])} type=x>var a = '{rng.choice('pqr')}';</{{0}}>".replace("{0}", "script") if rng.random() < 0.5 else "<style>p{}</style >")
        elif kind == 5:
            parts.append(f"<A class=c href={rng.choice(['/q?a=1&amp;b=2', chr(34) + 'with blank' + chr(34), chr(39) + 'é' + chr(39)])}>{word()}</A>")
        elif kind == 6:
            parts.append(rng.choice(["<br/>", "<hr>", "<img src=x alt='y'>", "<BR>"]))
        else:
            tag = rng.choice(["p", "div", "span", "b", "li", "H2"])
            parts.append(f"<{tag} id=i>{page_of(rng, depth + 1)}</{tag}>")
    return rng.choice([" ", "\n", ""]).join(parts)


@pytest.mark.parametrize("seed", range(40))
def test_against_the_standard_parser(seed):
    rng = random.Random(seed)
    body = page_of(rng).replace("<STYLE type=x>", "<script type=x>")
    page = f"<!DOCTYPE html><html class=k lang='fr-BE'><head><title>T{seed} &amp; {rng.choice('xyz')}</title></head><body>{body}</body></html>"
    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.out).split("\n"))
    assert plain_text(page) == "\n".join(line for line in lines if line)
    assert title_of(page) == " ".join(reader.title.split()) and language_of(page) == reader.language
    assert links_of(page) == reader.links


def test_archive_in_one_pass(spark):
    """Members are where file, offset and length say, and equal the ones that separate passes make."""
    rows = [(1, "http://a/1", PAGE), (1, "http://a/1", PAGE), (2, None, "<p>x</p>"), (3, "http://a/3", None), (None, "http://a/4", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"member": F.lit("clash"), "file": F.lit(1)}).repartition(2)
    whole = archive(pages, file_bytes=1500).cache()
    got = whole.collect()
    assert sorted(r["warc_type"] for r in got) == sorted(["response", "metadata", "conversion"] * 5)
    for name in {r["file"] for r in got}:
        parts = sorted((r for r in got if r["file"] == name), key=lambda r: r["offset"])
        data = b"".join(bytes(p["member"]) for p in parts)
        assert all(data[p["offset"] : p["offset"] + p["length"]] == bytes(p["member"]) for p in parts)
    assert len({r["file"] for r in got}) > 2
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(read_derivatives(whole.where("warc_type <> 'response'"))) == plain(read_derivatives(derive(response_members(pages))))
    assert archive(pages.limit(0)).count() == 0
