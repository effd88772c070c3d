import numpy as np

from cairnlake.llm import toxicity

WORDS = ["river", "stone", "walk", "bright", "morning", "house", "garden", "quiet", "people", "lantern"]


def text(i, bad):
    rng = np.random.default_rng(i)
    sentences = [" ".join(rng.choice(WORDS, 8)).capitalize() for _ in range(12)]
    if bad:
        sentences[i % 12] += f" {['scoundrel', 'wretchling', 'wretchous'][i % 3]}"
    return ". ".join(sentences) + "."


def test_offending_sentences_are_found_from_document_labels(spark, docs):
    rows = [(i, text(i, i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "morning house " * 40_000 + "wretchant"), (None, text(3, False)), (8, text(8, True))]
    got = toxicity.detect_toxicity(docs(rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    said = dict(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["predicted"] == int(r["doc_id"] % 4 == 0)
            if r["predicted"]:
                (span,) = r["spans"]
                assert any(w in said[r["doc_id"]][span["start"] : span["end"]] for w in ("scoundrel", "wretch"))
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1000]["predicted"] == by[1001]["predicted"] == 0 and by[1002]["predicted"] == 1
    assert toxicity.detect_toxicity(docs([]), labels).count() == 0
    assert {r["score"] for r in toxicity.detect_toxicity(docs(rows[:3]), labels.limit(0)).collect()} == {0.0}
    frame = docs(rows)
    kept = toxicity.clean_documents(frame, labels)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 4}


def test_gradient_learns_which_entry_matters():
    # Entry 0 is in every toxic document's one bad sentence, entry 1 in sentences of both classes.
    y, n, doc, sentence, entry = [], [], [], [], []
    for i in range(200):
        y.append(i % 2)
        n.append(5)
        for bag in ([[0], [1]] if i % 2 else [[1]]):
            sentence += [len(doc)] * len(bag)
            entry += bag
            doc.append(i)
    w, b = toxicity.fit_noisy_or(*map(np.asarray, (y, n, doc, sentence, entry)), 2)
    assert w[0] + b > 1 and w[1] + b < -2 and b < -2


def test_document_score_is_the_noisy_or():
    model = toxicity.NoisyOr({"bad ": 2.0, "mean ": 1.0}, -1.0)
    score, spans = model.locate("Bad day. Nice day! mean, bad")
    p = lambda z: 1 / (1 + np.exp(-z))
    assert np.isclose(score, 1 - (1 - p(1.0)) * (1 - p(-1.0)) * (1 - p(2.0)))
    assert [(a, b) for a, b, _ in spans] == [(0, 7), (18, 28)]
