"""Operators over pages: main text and WARC."""

import base64
import hashlib
import html
import io
import re

import pytest
from pyspark.sql import functions as F

from nearfield.llm import op3_extract as op3
from nearfield.llm import op5_warc as op5

PAGES = "page_id long, url string, html string, digest string, first long, n_chars int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://a/ü\n b", ""), (4, "u", "<p>x</p>"), (4, "u", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, None, "alone"), (7, "z", "é\r\n\r\nWARC/1.1\r\n" * 50_000)]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)


def test_articles_of_the_tables(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?p>|</?h1>", inner)]
        assert op3.main_text(r.html) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a &amp; b&nbsp;&lt;i&gt;\n c</p><p> </p><p>d<br>e</p>", "a & b <i> c\nd e"),
        ('<body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div id="content"><h2>Head</h2><p>First.<p>Second, <a href=x>linked</a> words.</div><aside><p>Side bar text</p></aside><footer>foot</footer>', "Head\nFirst.\nSecond, linked words."),
        ("<article><header><h1>T</h1></header><p>One</p><div class='ad'>Buy</div><p>Two</p></article><section class=comments><article class='comment'><p>first!</p></article></section>", "T\nOne\nTwo"),
        ("<main><p>A</p><form><input><p>Name</p></form><p>B</p></main><div class='cookie-notice'><p>We use cookies</p></div>", "A\nB"),
        ("<div class=sidebar><p>never closed<article><p>Body</p></article>", "Body"),
        ("<script>var a = '</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<p title='a > b'>x</p><p>1 < 2 and 3 > 2</p>", "x\n1 < 2 and 3 > 2"),
        ("<article><p>kept &am</p><ul><li>one<li>two</ul>", "kept &am\none\ntwo"),
        ('<article><div style="overflow:hidden"><p>Paragraph one.</p></div></article>', "Paragraph one."),
        ('<main><div data-id="menu-7"><p>Paragraph one.</p></div></main>', "Paragraph one."),
        ('<article><p title="the hidden valley">Paragraph one.</p><p>Two.</p></article>', "Paragraph one.\nTwo."),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>One.</p></article>', "Title\nOne."),
        ('<article><section id="search-for-truth"><h2>Search for truth</h2><p>One.</p></section></article>', "Search for truth\nOne."),
        ('<article><p>One.</p><div style="display: none"><p>Hidden</p></div><p hidden>Hidden</p><div class="post-comments"><p>first!</p></div><div id="related"><p>More</p></div><p>Two.</p></article>', "One.\nTwo."),
        ('<article><h1><a href=/x>Linked title</a></h1><p>Short.</p><ul><li><a href=/a>One story</a><li><a href=/b>Another story</a><li><a href=/c>A third</a></ul><p>That was the end, <a href=/d>see this</a>.</p></article>', "Linked title\nShort.\nThat was the end, see this."),
        ('<main><div class="site-cookie-bar">We use them</div><div class="wp-comments">No</div><div class="share-price"><p>The share price rose.</p></div></main>', "The share price rose."),
    ],
)
def test_main_text(page, text):
    assert op3.main_text(page) == text


LONG = "A sentence of the article goes on for quite a while, so that its line is a long one. " * 3
PARA = LONG.strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div id=top><p>Your region: north</p><p>Help</p></div><div id=x1><p>{LONG}</p><p>{LONG}</p></div><div id=y>All rights kept</div></body>", f"{PARA}\n{PARA}"),
        (f"<body><div id=top><a href=/>Home</a> <a href=/b>Products and prices of all kinds, by name</a></div><div id=x1><h2>Head</h2><p>{LONG}</p></div></body>", f"Head\n{PARA}"),
        (f"<div id=x1><p>{LONG}</p><p>{LONG}</p><div class=ad>Buy</div><p>A short end.</p></div><div id=y><p>Bottom words</p></div>", f"{PARA}\n{PARA}\nA short end."),
        (f"<div id=x1><p>{LONG}</p></div><aside>More</aside><div id=x2><p>Short.</p></div><aside>More</aside><div id=x3><p>{LONG}</p></div>", f"{PARA}\nShort.\n{PARA}"),
        (f"<div id=top>Site words</div><div id=t><h1>Title</h1></div><div id=x1><p>{LONG}</p></div>", f"Title\n{PARA}"),
    ],
)
def test_density_tells_the_article_where_nothing_marks_it(page, text):
    assert op3.main_text(page) == text


def test_extraction_of_awkward_rows(spark, odd):
    got = op3.extracted(odd).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text for r in got)[:2] == ["", ""] and op3.extracted(odd.limit(0)).collect() == []


def test_archives_are_read_back(spark, odd, sf):
    for pages in (odd, spark.read.parquet(f"{sf}/pages.parquet")):
        rows = pages.collect()
        got = op5.round_trip(pages.repartition(3)).collect()
        assert len(got) == len(rows)
        first = {}
        for r in rows:
            if r.page_id is not None:
                first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
        want = []
        for r in rows:
            data = (r.html or "").encode()
            again = (r.html or "") in first and r.page_id != first[r.html or ""] and sum((x.html or "") == (r.html or "") for x in rows) > 1
            want.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[r.html or ""] if again else None))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert op5.round_trip(odd.limit(0)).collect() == []
    small = op5.round_trip(odd, least=9).collect()
    assert {r.record_type for r in small} == {"response"}


def test_reader_sees_damage():
    fields = lambda block: [("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Block-Digest", f"sha1:{op5.base32(hashlib.sha1(block).digest())}")]
    good = op5.record(fields(b"hello"), b"hello") + op5.record(fields(b""), b"")
    assert [(s, p) for _, s, _, p in op5.records(io.BytesIO(good))] == [(5, b"hello"), (0, b"")]
    for bad in (good[:-5], op5.record(fields(b"hello"), b"jello"), op5.record([*fields(b"hello")], b"hello")[:20]):
        with pytest.raises((ValueError, KeyError)):
            list(op5.records(io.BytesIO(bad)))


def test_reader_holds_blocks_only():
    """A record of many blocks is verified without being kept."""
    block = b"0123456789" * 300_000
    data = op5.record([("WARC-Type", "resource"), ("WARC-Block-Digest", f"sha1:{op5.base32(hashlib.sha1(block).digest())}")], block)
    (_, size, _, kept), *_ = op5.records(io.BytesIO(data), payloads=False)
    assert size == len(block) and kept is None


def test_a_revisit_of_another_payload_is_an_error(spark, odd, monkeypatch):
    inner = op5.read_archives
    monkeypatch.setattr(op5, "read_archives", lambda archives, root: inner(archives, root).withColumn("payload_digest", F.when(F.col("record_type") == "revisit", "A").otherwise(F.col("payload_digest"))))
    with pytest.raises(ValueError, match="another payload"):
        op5.round_trip(odd)
