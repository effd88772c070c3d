import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from cairnlake.llm import alignment

FIRST, SECOND = alignment.ByteLevel(alignment.FIRST), alignment.Pieces(alignment.SECOND)
ALIGNER = alignment.Aligner(alignment.FIRST, alignment.SECOND)


def whole_text(text):
    """Tokens of both sides over the whole text, or None."""
    if not text:
        return None
    said = (" " + text).encode()
    a = FIRST.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = SECOND.model.encode(text)
    if b"".join(FIRST.bytes_of[i] for i in a) != said or b"".join(SECOND.bytes_of[i] for i in b) != said:
        return None
    return a, b


def aligned(text):
    """Brute force: (n_a, n_b, groups, links as id pairs)."""
    got = whole_text(text)
    if got is None:
        return 0, 0, "", []
    spans = []
    for ids, side in zip(got, (FIRST, SECOND), strict=True):
        at, mine = 0, []
        for i in ids:
            mine.append((at, at + len(side.bytes_of[i]), i))
            at = mine[-1][1]
        spans.append(mine)
    links, j = [], 0
    for s, e, a in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((a, spans[1][k][2]))
            k += 1
    ends, groups, i, j = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}, [], 0, 0
    for end in sorted(ends):
        left, right = [], []
        while i < len(spans[0]) and spans[0][i][1] <= end:
            left.append(str(spans[0][i][2]))
            i += 1
        while j < len(spans[1]) and spans[1][j][1] <= end:
            right.append(str(spans[1][j][2]))
            j += 1
        groups.append(f"{','.join(left)}|{','.join(right)}")
    return len(got[0]), len(got[1]), ";".join(groups), links


def expected(texts):
    done = [aligned(t) for t in texts]
    count = Counter(p for *_, links in done for p in set(links))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for n_a, n_b, groups, links in done:
        n_groups = groups.count(";") + 1 if groups else 0
        out.append((n_a, n_b, n_groups, len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), groups))
    return out


letters = st.text(st.sampled_from("aeT  \n\t.,'s09é日ﬁ  　▁\x00\x1c\x85​—“”<>|/"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(letters | st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=4))
@example([" ", "\n", "  two  blanks ", "a\n\nb \n c\n", "<|endoftext|>\n</s><s> [x]", "▁ ▁"])
def test_segments_give_what_whole_texts_give(texts):
    filled = [t for t in texts if t]
    if not filled:
        return
    got = ALIGNER.block([t.encode() for t in filled], digest=False)
    pairs = defaultdict(Counter)
    for d, c, n in zip(got["doc"], got["code"], got["times"], strict=True):
        pairs[d][divmod(int(c), ALIGNER.n_second)] += int(n)
    for i, t in enumerate(filled):
        n_a, n_b, groups, links = aligned(t)
        assert (got["n_a"][i], got["n_b"][i], got["groups"][i]) == (n_a, n_b, groups), t
        assert got["n_groups"][i] == (groups.count(";") + 1 if groups else 0) and pairs[i] == Counter(links)


def test_forgotten_segments_are_learned_again(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_BYTES", 0)
    for _ in range(2):
        got = ALIGNER.block([b"one two", b"two"], digest=False)
        assert got["groups"] == [aligned("one two")[2], aligned("two")[2]] and len(ALIGNER.known.groups) == 2


def test_segments_are_words():
    said = " one two\nthree  four five — six".encode()
    starts = alignment.segment_starts(np.frombuffer(said, np.uint8), np.array([0]))
    cut = [said[a:b].decode() for a, b in zip(starts, [*starts[1:], len(said)], strict=True)]
    assert cut == [" one", " two", "\nthree  four five — six"]


def some_texts():
    draw = random.Random(5)
    words = ["the", "The", "quick", "brownish", "tokenization", "Übergröße", "naïve", "日本語", "x1y2z3", "don't", "...", "\t", "\n", "http://a.b/c?d=e", "hot"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", " ", "\n", "  ", ""]) for _ in range(draw.randint(0, 60))) for _ in range(120)]
    return texts + [None, "", " ", "hot", "hot", "with ▁ inside", "<|endoftext|> </s>", "long " * 20_000 + "end", "z" * 30_000] + ["copied text here"] * 40


@pytest.mark.parametrize("split", [7, 4_000_000])
def test_documents_are_brute_force(spark, docs, monkeypatch, split):
    monkeypatch.setattr(alignment, "HELD_SHARES", 50)
    texts = some_texts()
    frame = docs([*enumerate(texts), (None, "no id"), (3, "again")]).repartition(3)
    rows = alignment.align(frame, split=split).collect()
    want = expected([*texts, "no id", "again"])
    ids = [*range(len(texts)), None, 3]
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, *w)) for i, w in zip(ids, want, strict=True))


def test_query(spark, docs, tmp_path):
    texts = some_texts()
    docs(list(enumerate(texts))).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = alignment.op11_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = {i: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in enumerate(expected(texts))}
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_empty_tables(spark, docs):
    assert alignment.align(docs([])).count() == 0
    assert [tuple(r) for r in alignment.align(docs([(1, None), (2, "")]).coalesce(1)).collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
