"""Archives and page texts."""

from __future__ import annotations

import glob
import gzip
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from crestline.llm import html_tree, warc
from crestline.llm.shared import open_store, scratch, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (9, None, "x" * 1500), (3, "http://a/3", "y" * 999), (4, "http://a/4", "y" * 999), (5, "http://a/5", None), (6, "http://a/6", ""), (None, "http://a/n", "null id"), (7, "http://a/ü x", "ü" * 700), (8, "u", "WARC/1.1\r\n\r\n" + "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("extra")).withColumn("payload", F.lit("extra"))


def test_round_trip(spark):
    pages = table(spark, SF, "pages")
    path = scratch(spark, "test-warc")
    got = {r["page_id"]: r for r in warc.archived(pages, path).collect()}
    for p in pages.collect():
        body, r = p["html"].encode(), got[p["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"], r["url"], r["record_type"]) == (len(body), hashlib.sha1(body).hexdigest(), p["url"], "response")
    assert len(got) == pages.count()


@pytest.mark.parametrize("size", [700, 5_000, 8 << 20])
def test_every_record_is_read_once_whatever_the_ranges(spark, pages, size):
    path = scratch(spark, "test-ranges")
    warc.write_archives(warc.with_revisits(pages).repartition(3), path).collect()
    got = warc.read_archives(spark, path, size, payloads=True).collect()
    assert sorted(r["page_id"] or -1 for r in got) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"], by[2]["refers_to"], by[9]["record_type"], by[9]["refers_to"]) == ("revisit", 9, 9, "response", None)
    assert by[1]["payload_bytes"] == 1500 and by[1]["payload_digest"] == by[9]["payload_digest"] == hashlib.sha1(b"x" * 1500).hexdigest() and by[1]["payload"] is None
    assert by[3]["record_type"] == by[4]["record_type"] == "response" and by[5]["payload_bytes"] == by[6]["payload_bytes"] == 0
    assert bytes(by[7]["payload"]) == ("ü" * 700).encode() and by[7]["payload_bytes"] == 1400 and by[9]["url"] is None
    assert by[8]["payload_bytes"] == 3_000_012


def test_members_are_plain_gzip(spark, pages):
    path = scratch(spark, "test-gzip")
    warc.write_archives(warc.with_revisits(pages).coalesce(1), path).collect()
    (file,) = glob.glob(f"{path.removeprefix('file://')}/*.warc.gz")
    with gzip.open(file) as f:
        assert f.read().count(b"WARC-Record-ID") == 10


def test_false_magic_is_passed_over():
    body = b"\x1f\x8b\x08" + gzip.compress(b"WARC/1.1 no record") + b"\x1f\x8b\x08\x00"
    record = warc.record(1, "u", body, hashlib.sha1(body).hexdigest(), None, "2024-01-01T00:00:00Z")

    class File:
        def __init__(self, data):
            self.data, self.at = data, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += n
            return out

    data = record + warc.record(2, "v", b"", hashlib.sha1(b"").hexdigest(), None, "2024-01-01T00:00:00Z")
    for size in (7, 50, 10_000):
        got = [warc.parsed(x)["page_id"] for k in range(0, len(data), size) for x in warc.members(File(data), len(data), k, k + size)]
        assert got == [1, 2]


def test_no_pages(spark, pages):
    assert warc.archived(pages.where("false"), scratch(spark, "test-empty")).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return html_tree.train(table(spark, SF, "pages"))


def test_article_of_given_pages(spark, model):
    for r in table(spark, SF, "pages").limit(40).collect():
        got = html_tree.extract([r["html"]], model)[0]
        part = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        page = html_tree.parse(part)
        assert got == "\n\n".join(t for _, t in page.blocks) and "track(" not in got


PAGES = {
    "divs": ('<html><body><div id="header"><h2>Site</h2><ul class="menu"><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></div><div class="sidebar"><h3>Related</h3><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class="content"><h1>Title</h1><p>First paragraph has words enough to be a sentence of text.</p><ul><li>A list item which has some words.</li></ul></div><div class="comments"><p>I liked it very much, thank you for writing all of this.</p></div><div class="cookie-notice"><p>We use cookies to make this site work, do you agree to that?</p></div><div id="footer">Copyright someone</div></body></html>', "Title\n\nFirst paragraph has words enough to be a sentence of text.\n\nA list item which has some words."),
    "semantic": ("<body><header><h1>Site</h1></header><main><article><h1>Title</h1><p>Text one is a sentence, with a number of words.</p><aside><p>Advert: buy this thing now, it is really quite good.</p></aside><p>Text two is another sentence with words.</p><form><label>Mail</label><button>Send</button></form></article></main><footer><p>All rights reserved by the owner of the site.</p></footer></body>", "Title\n\nText one is a sentence, with a number of words.\n\nText two is another sentence with words."),
    "references": ("<p>a &lt;b&gt; &amp; c&nbsp;d &eacute;&#233;\n  e<br>f <b>bold</b>ly</p><p>g", "a <b> & c d éé e f boldly\n\ng"),
    "empty": ("", ""), "null": (None, ""), "script": ("<script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->", ""), "loose": ("just words", "just words"), "hidden": ('<p>seen text here</p><div style="display:none"><p>not seen</p></div>', "seen text here"),
}


@pytest.mark.parametrize("name", PAGES)
def test_other_layouts(model, name):
    source, want = PAGES[name]
    assert html_tree.extract([source], model)[0] == want


def test_messages_equal_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    parents, codes = np.array([-1, 0, 0, 1, 1]), np.stack([rng.integers(0, n, 5) for n in html_tree.SIZES], axis=1)
    model = html_tree.fit([])
    depth = np.array([0, 1, 1, 2, 2])
    got = html_tree.marginals(parents, depth, codes, model)
    got = np.exp(got - got.max(1, keepdims=True))
    got /= got.sum(1, keepdims=True)
    want = np.zeros((5, 4))
    for states in itertools.product(range(4), repeat=5):
        p = sum(t[s, c] for s, row in zip(states, codes, strict=True) for t, c in zip(model.features, row, strict=True))
        p += sum(model.edges[states[parents[k]], states[k]] for k in range(1, 5))
        for k, s in enumerate(states):
            want[k, s] += np.exp(p)
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_pages_odd(spark, model):
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>" + "word " * 200_000), (None, "u", "<p>x</p>"), (4, "u", "<div>" * 3_000 + "deep")], "page_id long, url string, html string").withColumn("t", F.lit(1))
    got = {r["page_id"]: r["x"] for r in odd.select("page_id", html_tree.main_text(F.col("html"), model, odd).alias("x")).collect()}
    assert got[1] == got[2] == "" and got[None] == "x" and len(got[3]) == 999_999
    none = odd.where("false")
    assert none.select(html_tree.main_text(F.col("html"), html_tree.train(none), none)).count() == 0


def test_foreign_archives(spark):
    """Information, request and metadata records, chunked bodies, resources, padding and records without our ids."""
    import gzip

    def member(kind, block, **fields):
        head = "WARC/1.0\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "WARC_Record_ID": "<urn:uuid:1>", "Content_Length": len(block), **fields}.items())
        return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n")

    body = b"<p>" + b"x" * 5_000 + b"</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[:1000], body[1000:])) + b"0\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    data = member("warcinfo", b"software: x\r\n") + member("request", b"GET / HTTP/1.1\r\n\r\n") + member("response", chunked, WARC_Target_URI="<http://a/%20b>") + b"\0" * 700 + member("response", plain, WARC_Target_URI="http://c/") + member("metadata", b"x: y") + member("resource", body) + member("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest="sha1:" + "A" * 32)
    path = scratch(spark, "foreign")
    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/other.warc.gz", compression=None) as out:
        out.write(data)
    for size in (64, 1 << 20):
        got = warc.read_archives(spark, path, size, payloads=True).collect()
        assert sorted((r["record_type"], r["url"] or "", r["payload_bytes"] or 0) for r in got) == [("response", "", len(body)), ("response", "http://a/%20b", len(body)), ("response", "http://c/", len(body)), ("revisit", "", 0)]
        assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {body} and all(r["page_id"] is None for r in got)


def test_urls_and_repeated_ids_round_trip(spark):
    urls = ["http://a/b c", "http://a/b%20c", " tab\there ", "", None, "http://ü/ß\u00a0"]
    rows = spark.createDataFrame([(5, u, "y" * 2_000, "extra") for u in urls] + [(4, "u", "y" * 2_000, "extra")], "page_id long, url string, html string, first_id string").withColumn("refers_to", F.lit("mine"))
    got = warc.archived(rows, scratch(spark, "urls")).collect()
    assert sorted((r["url"] or "?", r["page_id"], r["record_type"], r["refers_to"]) for r in got) == sorted([(u or ("?" if u is None else "?"), 5, "response", None) for u in urls] + [("u", 4, "revisit", 5)])


def test_stray_and_many_quotes():
    import time

    assert [t for _, t in html_tree.parse('<p title="5" tall">Hello there</p><p class="x">Second</p>').blocks] == ["Hello there", "Second"]
    assert [t for _, t in html_tree.parse("<p title='a > b' x=\"<i>\">One</p>after").blocks] == ["One", "after"]
    began = time.time()
    for bad in ('<p ' + '"' * 10_000, '<p ' + 'a="' * 10_000, '<p a="' * 10_000 + '>"', "<" * 100_000, "<!--" * 10_000, "<! " * 10_000, "<a " * 10_000):
        html_tree.parse(bad + "<p>x")
    assert time.time() - began < 5


def test_hidden_elements():
    text = lambda x: [t for _, t in html_tree.parse(x).blocks]
    assert text('<div>a<p hidden>x<p>b</p></div>c') == ["a", "b", "c"]
    assert text('<div hidden><div>x</div>y</div>z') == ["z"]
    assert text('<section><div hidden>x<p>y</p></section>z') == ["z"]
    assert text('<p>a <span style="display:none">x <span>y</span> x</span> b</p>') == ["a b"]
    assert text('<p>a <span hidden>x</p><p>b</p>') == ["a", "b"]
    assert text('<ul><li hidden>x<li>b</ul>') == ["b"]


@pytest.mark.parametrize("bad", ["<p hidden>x", "<div hidden>x", "<div>", "<span hidden>x", "<li>y", "</section>", "<div hidden></div>", "<div><span hidden>"])
def test_parsing_is_linear(bad):
    began = time.time()
    html_tree.parse("<div>" * 60_000 + "</section>" * 60_000 if bad == "</section>" else bad * (1_000_000 // len(bad)))
    assert time.time() - began < 10  # a second or two, on a busy machine
