import pytest

from cairnlake.llm import warc


def test_chunked_framing():
    for body in (b"", b"x", b"y" * 10_000, "é€😀\r\n".encode() * 999):
        assert warc.unchunked(warc.chunked(body, 7)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


ROWS = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2", "same"), (4, None, None), (5, "u5", ""), (6, "u6", "é€😀\r\n\r\nWARC/1.1\r\n" * 5000), (7, "u7", "z" * 300_000), (8, "u8", "twice"), (8, "u8", "twice"), (None, "n", "same"), (None, "n", "alone")]


def test_pages_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(*r, "clash", 5) for r in ROWS], "page_id long, url string, html string, sha1 string, first int")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op8_warc(spark, str(tmp_path)).collect()
    want = []
    for page_id, _, html in ROWS:
        payload = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        kind = "response" if first is None or page_id == first else "revisit"
        want.append((page_id, len(payload), warc.bare_digest(payload), kind, first if kind == "revisit" else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, want)) == sorted(key((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)


def test_segments_are_ordered_and_verified(spark):
    whole = list(warc.records_of("urn:x", "u", b"p" * 5000, None, 1024))
    assert len(whole) > 4
    rows = []
    for record in reversed(whole):
        for h, block in warc.parsed(record + b"\r\n\r\n"):
            rows.append((h["warc-type"], h["warc-record-id"].strip("<>"), "u", None, h.get("warc-payload-digest"), h.get("warc-segment-origin-id", h["warc-record-id"]).strip("<>"), int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block))
    frame = lambda some: spark.createDataFrame(some, warc.RAW)
    (good,) = warc.reassembled(frame(rows)).collect()
    assert bytes(good["payload"]) == b"p" * 5000 and good["problem"] is None
    (missing,) = warc.reassembled(frame(rows[:-2] + rows[-1:])).collect()
    assert missing["payload"] is None and missing["problem"] == "segments are missing or repeat"
    (cut,) = warc.reassembled(frame(rows[1:])).collect()
    assert cut["problem"] == "the total length differs"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op8_warc(spark, str(tmp_path)).count() == 0
