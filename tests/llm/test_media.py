import hashlib
import re
import time
import zlib
from html import unescape
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm import media

PAGES = Path("/root/testdata/sf0.01/pages.parquet")


def test_sequence_keeps_order_positions_and_captions():
    html = "<p>one</p><figure><img src='a.png' alt='x'><figcaption>A <b>cap</b></figcaption></figure><script>no()</script>two<img src='b.png' alt='bb'>three"
    got = media.sequence_of(html)
    assert [(e["position"], e["kind"], e["text"] or e["src"], e["caption"]) for e in got] == [
        (0, "text", "one", None),
        (1, "media", "a.png", "A cap"),
        (2, "text", "two", None),
        (3, "media", "b.png", "bb"),
        (4, "text", "three", None),
    ]
    assert media.sequence_of("") == []
    assert media.sequence_of("<figure><img src=x>")[0]["kind"] == "media"


BROKEN = {
    "<figure><img src=a><script>var x": [("a", None)],
    "<figure><img src=a alt=q><template>x": [("a", "q")],
    "<figure><img src=a><noscript>x": [("a", None)],
    "<figure><img src=a><figcaption>x</figure></figcaption>y": [("a", "x"), "y"],
    "<html><head><title>t</title><body><p>hi</p><img src=a>": ["hi", ("a", None)],
    "<div><figure><img src=a><figcaption>cap</div><p>after</p>": [("a", "cap"), "after"],
    "<figure><figcaption><p>one</p><p>two</p></figcaption><img src=a></figure>": [("a", "one two")],
    "<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out": [("a", "out"), ("b", "in")],
    "</figure></figcaption></div>x</template>y": ["xy"],
    "<div><template><div></div><img src=no></template>x</div>": ["x"],
    "<figcaption>alone</figcaption>text": ["alone", "text"],
    "a<br/>b<script/>c": ["a", "bc"],
}


@pytest.mark.parametrize("html", BROKEN)
def test_broken_pages(html):
    assert [e["text"] or (e["src"], e["caption"]) for e in media.sequence_of(html)] == BROKEN[html]


TAGS = ["figure", "figcaption", "div", "p", "script", "style", "template", "noscript", "head", "title", "body", "table", "td", "b", "ul", "li"]
PIECES = [f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS] + ["<img src=a alt=b>", "<br/>", "<figure/>", "<script/>", "word", " ", "&amp;", "<!--", "-->", "<![CDATA[", "<![x[", "]]>", "<!doctype", "<?", "<", ">", "</", "&#x", '"', "<a href='", "<img src="]


@settings(max_examples=400, deadline=2000)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_any_soup_of_tags_parses(html):
    got = media.sequence_of(html)
    assert [e["position"] for e in got] == list(range(len(got))) and all(e["text"] or e["src"] for e in got)


def test_long_nests_take_linear_time():
    began = time.process_time()
    for html in ("<div>" * 100_000 + "</section>" * 100_000, "<figure><figcaption>" * 50_000 + "x" + "</figure>" * 50_000, "</div>" * 200_000):
        media.sequence_of(html)
    assert time.process_time() - began < 60


@pytest.mark.parametrize("html", [
    "<figcaption>" * 80_000, "<figure>" + "<figcaption>" * 80_000, "<a" * 500_000, "<!--" * 250_000, "<a href='" * 110_000, '<a b="' * 170_000, "<a " * 330_000 + ">", "<!" * 500_000, "</" * 500_000, "</a" * 330_000,
    "<script>" * 120_000, "<" * 1_000_000, "<a b=" * 200_000, "<p <p" * 200_000 + ">", "&" * 1_000_000, "&#x" * 330_000, "<a/" * 330_000, "<a\t=" * 250_000, "<style></style" * 70_000, "<![CDATA[" * 110_000, "<figure><img src=a><figcaption>x" * 30_000,
], ids=range(21))
def test_a_megabyte_of_anything_takes_seconds(html):
    began = time.process_time()
    media.sequence_of(html)
    assert time.process_time() - began < 4


UNFINISHED = {
    "a<b": ["a"], "a< b": ["a< b"], "a<!-- b": ["a"], "a<img src='x": ["a"], "a<img src=x": ["a"], "a</p": ["a"], "a<!x": ["a"], "a<script>b": ["a"], "a<script>b</script >c": ["ac"], "<style>a</STYLE>b": ["b"], "<script>a</scripts>b</script>c": ["c"],
    "<img alt='>' src='x&amp;y'>": [("x&y", ">")], "<IMG SRC=x/y ALT>": [("x/y", None)], "<img / src = x / alt=b/>": [("x", "b/")], "a<!-->b": ["ab"], "1 < 2 &lt; 3": ["1 < 2 < 3"], "<img src=''>a": ["a"],
}


@pytest.mark.parametrize("html", UNFINISHED)
def test_tags(html):
    assert [e["text"] or (e["src"], e["caption"]) for e in media.sequence_of(html)] == UNFINISHED[html]


def visible(html):
    """The words outside tags by substitution: hidden elements go, block tags part words, others don't."""
    html = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", html)
    html = re.sub(r"</?(a|b|meta|link|html|head|!doctype)\b[^>]*>", "", html, flags=re.I)
    return unescape(re.sub(r"<[^>]*>", " ", html)).split()


@pytest.mark.skipif(not PAGES.exists(), reason="the test tables are not here")
def test_pages_keep_their_visible_words(spark):
    pages = spark.read.parquet(str(PAGES))
    got = {r["doc_id"]: r["elements"] for r in media.parse_sequences(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows) > 0
    for page_id, html in rows:
        assert [e["position"] for e in got[page_id]] == list(range(len(got[page_id])))
        assert " ".join(e["text"] for e in got[page_id]).split() == visible(html)


def test_digests_resolve_once(spark):
    d = "0" * 64
    pages = spark.createDataFrame([(1, f"<p>t</p><img src='digest:sha256-{d}'>"), (1, f"<img src='digest:sha256-{d}'>"), (2, "<img src='digest:sha256-" + "1" * 64 + "'>"), (3, None)], "page_id long, html string")
    stored = spark.createDataFrame([(d, b"x", 1), (d, b"x", 1)], "digest string, payload binary, size int")
    got = media.resolve(media.parse_sequences(pages), stored).collect()
    assert sorted((r["doc_id"], r["position"], str(r["medium"] and bytes(r["medium"]["payload"]))) for r in got) == [(1, 0, "None"), (1, 0, "b'x'"), (1, 1, "b'x'"), (2, 0, "None")]


def test_payloads_round_trip(spark, docs, tmp_path):
    texts = [(1, None), (2, ""), (3, "ab\x00é€😀"), (4, "x" * 64), (5, "y " * 70_000), (6, "same"), (7, "same"), (7, "same"), (None, "n")]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    rows = media.op1_media(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got[r["doc_id"]] = r
    for doc_id, text in texts:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.to_pgm(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(float)
        columns = x.reshape(-1, 64).mean(axis=0)
        bits = "".join("1" if c > x.mean() else "0" for c in columns)
        assert r["feature"] == f"mean={x.mean():.4f};sd={x.std():.4f};profile={int(bits, 2):016x}"
    assert got[6]["feature"] == got[7]["feature"]


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert media.op1_media(spark, str(tmp_path)).count() == 0


def test_every_page_has_its_sequence(spark, tmp_path):
    rows = [(1, "<p>one<figure><img src=a alt=b><figcaption>cap</figcaption></figure>two"), (2, None), (3, ""), (None, "<img src=x>"), (4, "w " * 200_000), (1, "again")]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, html string, elements string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(str, map(tuple, media.media_sequences(spark, str(tmp_path)).collect())))
    want = []
    for i, html in rows:
        es = media.sequence_of(html or "")
        told = "\n".join(f"{e['kind']}|{e['text'] or e['src']}|{e['caption'] or ''}" for e in es)
        want.append((i, len(es), sum(e["kind"] == "text" for e in es), sum(e["kind"] == "media" for e in es), sum(e["caption"] is not None for e in es), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(map(str, want))
