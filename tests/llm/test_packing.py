import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnlake.llm import packing


def reference_ids(text):
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


ODD = ["", " ", "Ab, cd!", "don't's 'S", "a\tb\x0bc d e\x1cf", "É È ſ ﬁ ΑΣ", "é ́x", "a<|endoftext|>b", "ÀB.C", "12.5%%", "x" * 200 + "...", "  two\n\nlines ", "ßẞİ", "日本語 text"]


ENCODER = packing.WordEncoder("word_bpe_49k.json")


def test_words_are_encoded_as_the_whole_text_is():
    encoder = ENCODER
    for text in ODD + [" ".join(ODD)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference_ids(text), text


ALPHABET = "aAzZéÉßµªº\u00c0\u00de\u00fe .,;:!?%$#&*|'’stT012<>|\u0327\u0301ﬁǅ漢Ω\t\n\x1c\u0085\u200b-_()"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ALPHABET, "<|endoftext|>", "word"]), max_size=30).map("".join), min_size=1, max_size=4))
def test_batches_of_odd_texts_are_encoded_as_each_is(texts):
    ids, begins = ENCODER.encode_all(texts)
    for text, a, b in zip(texts, begins[:-1], begins[1:], strict=True):
        assert ids[a:b].tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    encoder = packing.WordEncoder("word_bpe_49k.json")
    for text in ["one two three four five six", "six one, Two... seven"] * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_patterns_place_every_length_once(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    placed = Counter()
    for count, runs in patterns:
        assert count > 0 and sum(n * k for n, k in runs) <= 64
        for n, k in runs:
            placed[n] += count * k
    assert placed == Counter(histogram)
    # Two sequences that are both at most half full would have been one.
    assert sum(count for count, runs in patterns if sum(n * k for n, k in runs) <= 32) <= 1


def test_packed_documents(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["river", "Stone,", "été", "12"], n))) for i, n in enumerate([1, 5, 5, 5, 700, 3000, 2047, 9000])] + [(50, None), (51, ""), (None, "abc"), (7, "again"), (7, "again")]
    got = packing.pack_documents(docs(rows), with_ids=True).collect()
    pieces = {}
    for r in got:
        ids = r["ids"]
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(np.asarray(ids, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows[:-2]:
        own = sorted((r for r in pieces[doc_id] if doc_id != 7 or r["doc_tokens"] > 100), key=lambda r: r["start"])
        want = reference_ids(text or "") + [1]
        assert [x for r in own for x in r["ids"]] == want and {r["doc_tokens"] for r in own} == {len(want)}
        assert [r["start"] for r in own] == list(range(0, len(want), 2048))
    assert len([r for r in pieces[7] if r["doc_tokens"] < 100]) == 2
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))
    assert packing.pack_documents(docs([])).count() == 0
