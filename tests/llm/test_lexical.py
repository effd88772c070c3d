import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm import lexical

ITEMS = "item_id long, text string, score string, rank string"


def terms_by_pattern(text):
    return re.findall(lexical.TERM, (text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8")) | st.text("aZ09_-ßÉ  \x00\x7f\x80\n"))
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for t in lexical.terms_of(text)] == terms_by_pattern(text)


def ranked(documents, items, k=10):
    """Brute force: every document for every item."""
    docs = [(i, Counter(terms_by_pattern(t)), len(terms_by_pattern(t))) for i, t in documents]
    docs = [d for d in docs if d[2]]
    n_docs, n_terms = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms_by_pattern(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, d[3], -d[0]) for r, d in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def some(seed=1):
    draw = random.Random(seed)
    words = ["the", "The", "cat", "dog", "Été", "été", "x9", "über", "river", "stone", "a", "b", "c", "日本"]
    documents = [(i, " ".join(draw.choices(words, [60, 20, 5, 5, 3, 3, 2, 2, 2, 2, 9, 9, 9, 1], k=draw.randint(0, 40)))) for i in range(300)]
    documents += [(i, "tie of stone") for i in range(1000, 1060)] + [(None, "tie of stone")] * 2 + [(7, "tie of stone"), (5000, None), (5001, "... \n"), (5002, "long " * 30_000 + "river")]
    items = [(1, "the cat, the dog"), (2, "Stone tie"), (3, "Été über-river 日本"), (4, "unknown"), (5, None), (6, "!"), (7, "long RIVER the x9 x9 x9"), (2, "stone"), (None, "cat")]
    return documents, items


@pytest.mark.parametrize("shard_bytes, max_items, max_terms", [(1 << 20, 1000, 1000), (500, 2, 1000), (3000, 100, 3)])
def test_search_is_brute_force(spark, docs, shard_bytes, max_items, max_terms):
    documents, items = some()
    frame = docs(documents)
    size = lexical.collection_size(frame)
    index = lexical.stored(lexical.index_shards(frame, *size, shard_bytes=shard_bytes), "index")
    asked = spark.createDataFrame([(*i, "clash", "clash") for i in items], ITEMS)
    for k in (1, 10, 100):
        got = lexical.search(index, asked, size[0], k, max_items, max_terms).collect()
        assert sorted(str(tuple(r)) for r in got) == ranked(documents, items, k)
    assert index.count() > 30 or shard_bytes > 500


def test_query_and_sql(spark, docs, tmp_path):
    documents, items = some(2)
    docs(documents).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*i, "clash", "clash") for i in items], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = lexical.op13_lexical(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted(str(tuple(r)) for r in got.collect())
    assert rows == ranked(documents, items)
    oracle = duckdb.connect()
    for t in ("documents", "benchmark"):
        oracle.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(str, oracle.execute(lexical.OP13_SQL).fetchall())) == rows


def test_empty_tables(spark, docs):
    no_items = spark.createDataFrame([], ITEMS)
    for documents, items in (([], [(1, "a")]), ([(1, None), (2, " ")], [(1, "a")])):
        index, n = lexical.build_index(docs(documents))
        assert n == 0 and lexical.search(index, spark.createDataFrame([(*i, "", "") for i in items], ITEMS), n).count() == 0
    index, n = lexical.build_index(docs([(1, "a")]))
    assert n == 1 and lexical.search(index, no_items, n).count() == 0


def test_selection_looks_at_whole_ties():
    ids, none = np.array([5, 4, 3, 2, 1, 0]), np.zeros(6, bool)
    assert lexical.best(np.array([7, 7, 7, 7, 7, 0]), none, ids, 2).tolist() == [4, 3]
    assert lexical.best(np.array([0, 0, 0, 9, 0, 0]), none, ids, 3).tolist() == [3]
    none[0] = True
    assert lexical.best(np.array([7, 7, 8, 7, 7, 0]), none, ids, 2).tolist() == [2, 0]
