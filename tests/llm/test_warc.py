"""Operator 6."""

import html
import random
import time
from html.parser import HTMLParser

import pytest

from terrafold.llm import warc

PAGE = "page_id long, url string, html string, block string, intact string"


def test_odd_pages(spark):
    long = "<p>" + "word &amp; more " * 100_000 + "</p>"
    rows = [(1, "http://a/", "<p>one</p>"), (1, "http://a/", "<p>two</p>"), (None, "http://a/", "<p>one</p>"), (None, "http://a/", "<p>two</p>"), (2, None, None), (3, "", ""), (4, "http://b/\r\nX-Page-ID: 9", long), (5, "http://c/", "<p>same</p>"), (5, "http://c/", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGE)
    got = warc.round_trip(pages).collect()
    assert len(got) == 2 * len(rows) and all(r.intact and r.block_digest == warc.digest(bytes(r.block)) and r.block_length == len(r.block) for r in got)
    assert len({r.record_id for r in got}) == 2 * len(set(rows))
    want = sorted((repr(r.page_id), r.record_type, r.record_id, r.refers_to, r.source_headers, r.source_digest, bytes(r.block)) for r in warc.derive(warc.responses(pages)).collect())
    assert sorted((repr(r.page_id), r.record_type, r.record_id, r.refers_to, r.source_headers, r.source_digest, bytes(r.block)) for r in got) == want
    texts = {(r.page_id, bytes(r.block)) for r in got if r.record_type == "conversion"}
    assert (4, ("word & more " * 100_000).strip().encode()) in texts and (2, b"") in texts and (1, b"one") in texts and (1, b"two") in texts
    assert {r.page_id for r in got} == {1, 2, 3, 4, 5, None}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_null_responses(spark):
    rows = [(None,) * 6, (7, None, "http://a/", None, "HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\n", None)]
    derived = warc.derive(spark.createDataFrame(rows, warc.RESPONSE))
    got = sorted(warc.from_warc(warc.as_warc(derived)).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to, r.target_uri) for r in got] == [(None, "conversion", None, None), (None, "metadata", None, None), (7, "conversion", None, "http://a/"), (7, "metadata", None, "http://a/")]
    assert b"http-status: 404\r\n" in bytes(got[3].block) and b"http-server: x" in bytes(got[3].block) and len({r.record_id for r in got}) == 4


def test_many_members_in_one_file(spark, tmp_path):
    body = b"x" * 100
    members = [warc.warc_bytes("response", f"<urn:{i}>", f"http://a/{i}", warc.DATE, "application/http", b"HTTP/1.1 200 OK\r\n\r\n" + body, {}) for i in range(3000)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "empty.warc").write_bytes(b"")
    read = warc.read_responses(spark, str(tmp_path)).collect()
    assert len(read) == 3000 and {r.record_id for r in read} == {f"<urn:{i}>" for i in range(3000)} and all(bytes(r.body) == body for r in read)


class Reader(HTMLParser):
    """What a page says, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], None

    def handle_starttag(self, tag, attrs):
        if self.hidden is None and tag in warc.HIDDEN:
            self.hidden = tag
            self.out.append(" ")
        elif self.hidden is None:
            self.out.append("\n" if tag in warc.BREAKING else "")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden == tag:
            self.hidden = None
        elif self.hidden is None:
            self.out.append("\n" if tag in warc.BREAKING else "")

    def add(self, data):
        if self.hidden is None:
            self.out.append(data)

    handle_data = add

    def handle_comment(self, data):
        self.add(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_entityref(self, name):
        self.add(f"&{name};")

    def handle_charref(self, name):
        self.add(f"&#{name};")


def read(page: str) -> str:
    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = [" ".join(x.split()) for x in html.unescape("".join(reader.out)).split("\n")]
    return "\n".join(x for x in lines if x)


def test_pages_equal_another_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    assert len(pages) > 100
    for page in pages:
        assert warc.plain_text(page) == read(page)


@pytest.mark.parametrize("page, text", [
    ('<a title="x > y">link</a>', "link"), ("<a title='x > \"y\"'>link</a>", "link"), ("<p title=don't>one</p>two", "one\ntwo"), ("a < b and c <3", "a < b and c <3"), ("x<b", "x"), ("x<a href=\"y>z</a>", "x"),
    ("<script>if (a < b) '</p>'</script >after", "after"), ("<SCRIPT src=x>one</sCript>two", "two"), ("<style>never closed", ""), ("<!-- a > b -->c<!-->d<!--->e", "c d e"), ("<!-- never", ""), ("<!doctype html>t", "t"), ("<?php x ?>y", "y"), ("</ bogus>z", "z"),
    ("<scripty>kept</scripty>", "kept"), ("<b>bo</b>ld", "bold"), ("<br/>a<br>b", "a\nb"), ("&lt;p&gt; &amp;amp;", "<p> &amp;"), ("<a b=>c", "c"), ("", ""), ("<", "<"), ("<script></script", ""), ("<template><p>no</p></template>yes", "yes"), ("<a\nhref = 'x>'\n>ok", "ok"),
])
def test_small_pages(page, text):
    assert warc.plain_text(page) == text


HOSTILE = ["<p ", "<!doctype ", "<a b=\"", "<a b='", "<!--", "<script>", "<script", "</", "<", "<a =", "<a b=\"c>", "<p>", "&", "&#", "<style></styl", "<?", "< ", "<a b = ", "</script", "<!-- --", "<a\"'"]


@pytest.mark.parametrize("part", HOSTILE)
def test_ten_megabytes_of_anything_are_read_once(part):
    page = part * (10_000_000 // len(part))
    began = time.process_time()
    warc.plain_text(page)
    short = time.process_time()
    assert short - began < 20
    warc.plain_text(page[: len(page) // 4])
    # A quarter of the page takes about a quarter of the time.
    assert time.process_time() - short > (short - began) / 12 or short - began < 2


def test_any_mixture_ends(monkeypatch):
    rng = random.Random(6)
    for _ in range(300):
        page = "".join(rng.choices([*HOSTILE, "text ", ">", "\"", "'", "-->", "</script>", "\n"], k=60))
        text = warc.plain_text(page)
        assert text == warc.plain_text(page) and "\n\n" not in text


def test_files_of_derivatives(spark, tmp_path):
    """What is written are WARC files of their own, read here by hand and by Spark."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>caf\u00e9 {i}</p>\n\n" * (i % 5), "-", "-") for i in range(60)] + [(None, None, None, "-", "-")], PAGE).repartition(3)
    derived = warc.derive(warc.responses(pages))
    path = str(tmp_path / "out")
    assert warc.write_warc(derived, path) == len(list((tmp_path / "out").glob("part-*.warc.gz"))) == 3
    heads = [h for f in (tmp_path / "out").glob("*.warc.gz") for h, block in warc.records_in(f.read_bytes()) if warc.digest(block) == h["warc-block-digest"]]
    assert len(heads) == 122
    plain = lambda rows: sorted(repr(tuple(r)[: len(derived.columns)]) for r in rows)
    assert plain(warc.read_derivatives(spark, path).collect()) == plain(derived.collect())
    with pytest.raises(Exception, match="exist"):
        warc.write_warc(derived, path)
