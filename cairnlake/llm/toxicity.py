"""Toxicity by multiple-instance learning: sentences get scores, documents their noisy-or, labels are documents' only.

A sentence's score is logistic in the words and word beginnings it has out of a vocabulary; a document is toxic unless
all its sentences are clean: 1 - prod(1 - p). The weights are fitted by gradient to the documents' labels alone, so the
sentences that make a document toxic are found in passing; ``locate`` reports them.

The vocabulary (``VOCABULARY`` words and beginnings whose document counts differ most between the classes) and the
weights are learned from at most ``MAX_LABELLED`` labelled documents of each class that are not held out, those whose
ids hash lowest: a table of bounded size, the only thing that is broadcast. What the driver fits the weights on, the
vocabulary's entries by sentence, is held to ``MAX_BAG_BYTES`` by taking fewer of those documents, again by hash, should
they be very long. Whole texts are read, in learning and in scoring.

Defined results: null and empty texts count as one empty sentence; a document with several labels has the largest; null
ids are held out; rows that repeat are rows of the result; without labelled rows of both classes every score is 0;
labels, lang, source and doc_id are no inputs of a score; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, is_held_out, map_rows, one_label, stored, table

THRESHOLD = 0.5
VOCABULARY = 4096
MAX_LABELLED = 25_000
MAX_BAG_BYTES = 64 << 20
#: Lengths of the word beginnings that count beside whole words.
BEGINNINGS = (3, 4, 5, 6)
#: Documents of the toxic class that a vocabulary entry must occur in.
LEAST_DOCUMENTS = 3
#: Its toxic documents exceed those expected by so many standard errors.
LEAST_EXCESS = 4.0
STEPS, RATE, DECAY = 400, 0.1, 3e-5
CACHE_WORDS = 200_000
#: Features that a counting task holds before it hands them on.
HELD_FEATURES = 500_000

LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(chunk: str) -> set[str]:
    """Words, marked with a final blank, and word beginnings of a piece of text without blanks."""
    found = set()
    for word in LETTERS.findall(chunk.lower()):
        found.add(word + " ")
        found.update(word[:k] for k in BEGINNINGS if k <= len(word))
    return found


@dataclass
class NoisyOr:
    """Weights by vocabulary entry and the bias of a sentence."""

    weights: dict[str, float]
    bias: float
    #: Chunk -> its entries.
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def entries(self, chunk: str) -> tuple[str, ...]:
        found = self.known.get(chunk)
        if found is None:
            found = tuple(f for f in features_of(chunk) if f in self.weights)
            if len(chunk) <= 64:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[chunk] = found
        return found

    def sentences(self, text: str | None) -> tuple[int, list[tuple[int, int, set[str]]]]:
        """The number of sentences, and (start, end, entries) of those that have any entry."""
        text, get, known = text or "", self.entries, self.known
        n = max(1, len(SENTENCE.findall(text)))
        if not any(known[c] if c in known else get(c) for c in text.split()):
            return n, []
        out = []
        for m in SENTENCE.finditer(text):
            entries = {f for chunk in m[0].split() for f in get(chunk)}
            if entries:
                out.append((m.start(), m.end(), entries))
        return n, out

    def locate(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of the sentences that are rather toxic than not."""
        n, some = self.sentences(text)
        log_clean = -(n - len(some)) * np.logaddexp(0, self.bias)
        spans = []
        for start, end, entries in some:
            z = self.bias + sum(self.weights[f] for f in sorted(entries))
            log_clean -= np.logaddexp(0, z)
            if z >= 0:
                spans.append((start, end, float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(log_clean)), spans


def fit_noisy_or(y: np.ndarray, n_sentences: np.ndarray, doc: np.ndarray, sentence: np.ndarray, entry: np.ndarray, n_entries: int) -> tuple[np.ndarray, float]:
    """(weights, bias) that make the noisy-or of sentence scores fit the document labels, by Adam on the log loss.

    ``doc`` has the document of each sentence with entries; ``sentence`` and ``entry`` are such sentences' entries.
    """
    w, b = np.zeros(n_entries), -3.0
    first, second = np.zeros(n_entries + 1), np.zeros(n_entries + 1)
    bare = n_sentences - np.bincount(doc, minlength=len(y))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    # Both classes weigh alike in all.
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, STEPS + 1):
        z = np.clip(b + np.bincount(sentence, w[entry], minlength=len(doc)), -30, 30)
        log_clean = -np.bincount(doc, np.logaddexp(0, z), minlength=len(y)) - bare * np.logaddexp(0, b)
        clean = np.exp(log_clean)
        pull = share * np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        per_sentence = pull[doc] * sigmoid(z)
        gradient = np.append(np.bincount(entry, per_sentence[sentence], minlength=n_entries) + DECAY * w, per_sentence.sum() + (pull * bare).sum() * sigmoid(b))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], float(np.clip(b - move[-1], -14, 5))
    return w, b


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y): at most ``max_labelled`` of each class."""
    known = one_label(labels, "toxic").where(~is_held_out(F.col("doc_id")))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for y in (0, 1)]
    return some[0].unionByName(some[1])


def select_vocabulary(texts: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The entries with the largest signed chi-square-like excess in toxic documents, from (text, y)."""

    def counted(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[str, list[int]] = {}
        for text, y in rows:
            for f in set().union(*map(features_of, set((text or "").split()))):
                held.setdefault(f, [0, 0])[y] += 1
            if len(held) >= HELD_FEATURES:
                yield from ((f, *n) for f, n in held.items())
                held = {}
        yield from ((f, *n) for f, n in held.items())

    counts = map_rows(texts.select("text", "y"), counted, "entry string, clean long, toxic long")
    counts = counts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_DOCUMENTS)
    totals = texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["y"]: r["n"] for r in totals}
    if not n.get(0) or not n.get(1):
        return []
    expected = (F.col("clean") + 1) * (n[1] / (n[0] + 1))
    excess = (F.col("toxic") - expected) / F.sqrt(expected)
    return [r["entry"] for r in counts.where(excess >= LEAST_EXCESS).orderBy(excess.desc(), "entry").limit(size).collect()]


def train(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, max_labelled: int = MAX_LABELLED, max_bag_bytes: int = MAX_BAG_BYTES) -> NoisyOr | None:
    """The model; None without documents of both classes."""
    sample = F.broadcast(labelled_sample(labels, max_labelled))  # at most twice max_labelled rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("doc_id", "text", "y")
    entries = select_vocabulary(texts, vocabulary)
    if not entries:
        return None
    at = {f: i for i, f in enumerate(entries)}
    blank = NoisyOr(dict.fromkeys(entries, 0.0), 0.0)

    def bags(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, y in rows:
            n, some = blank.sentences(text)
            found = [sorted(at[f] for f in entries) for _, _, entries in some]
            yield doc_id, y, n, np.array([len(f) for f in found], "<i4").tobytes(), np.array([x for f in found for x in f], "<i4").tobytes()

    # Four bytes an entry and sentence, in a few arrays: lists of lists would take the driver many times that.
    made = stored(map_rows(texts, bags, "doc_id long, y long, n long, sizes binary, entries binary"), "bags")
    size = made.agg(F.sum(16 + F.length("sizes") + F.length("entries")).alias("bytes")).first()["bytes"] or 0
    if size > max_bag_bytes:
        made = made.where(F.pmod(F.xxhash64(F.lit("bag"), "doc_id"), F.lit(1 << 20)) < int(max_bag_bytes / size * (1 << 20)))
    held = made.select("y", "n", "sizes", "entries").toArrow()
    y, n = (held.column(c).to_numpy() for c in ("y", "n"))
    sizes, found = (held.column(c).to_pylist() for c in ("sizes", "entries"))
    doc = np.repeat(np.arange(len(y)), [len(x) // 4 for x in sizes])
    size = np.frombuffer(b"".join(sizes), "<i4")
    sentence, entry = np.repeat(np.arange(len(size)), size), np.frombuffer(b"".join(found), "<i4")
    del held, sizes, found
    weights, bias = fit_noisy_or(y, n, doc, sentence, entry, len(entries))
    return NoisyOr({f: float(w) for f, w in zip(entries, weights, strict=True)}, bias)


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,score:double>>"


def located(docs: DataFrame, model: NoisyOr | None) -> DataFrame:
    """(doc_id, score, spans): ``spans`` are the sentences that make a document toxic, by character."""

    def rows(got: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in got:
            score, spans = model.locate(text) if model else (0.0, [])
            yield doc_id, score, [{"start": a, "end": b, "score": p} for a, b, p in spans]

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, SCORED)


def detect_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), a row per document."""
    out = located(docs, train(docs, labels))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, whole rows."""
    model = train(docs, labels)
    return filter_rows(docs, lambda texts: [model is None or model.locate(t)[0] < threshold for t in texts], "text")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    found = detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_sentences"), F.get("spans", F.lit(0))["start"].alias("first_start"))
