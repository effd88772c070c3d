"""Ranked lexical search: document-sharded postings in CSR form with precomputed integer impacts.

``build_index`` turns documents into shards of about ``SHARD_BYTES`` of text. A shard is one row: the ids of its
documents, its terms in order, where each term's postings begin, and the postings themselves - a document's ordinal in
the shard and its integer impact, which holds all of a score but the term's weight. Impacts need the corpus's number of
documents and of terms, which a pass before counts. The index is an ordinary table of all terms
and serves any number of searches.

``search`` takes the queries in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` terms, so what a task gets
with its code is bounded whatever the query table holds. For each block one pass over terms and postings' places, not
postings, sums document frequencies; then each shard scores its documents term at a time into a dense numpy accumulator
and selects by ``argpartition``: everything above the k-th score, and of what equals it the smallest ids. A task merges
the winners of its shards, and a window limit per item, salted first, merges those of all tasks. A common term costs the
shards that hold it their share each; no posting list is ever in one place.

Defined results: null texts and texts without a term are no documents of the collection; an item without terms (or with
terms that no document has, or that weigh 0) has no rows; equal scores go by ascending id, a null id first; rows that
repeat an id are documents of their own, rows that repeat an item's id are one item; empty tables give no rows; other
columns are ignored. A text of any length is one document; one that is longer than a shard is a shard of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, pieces_of, released, stored, table

#: A term is a maximal run of these characters, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Share (in hundredths) of a document's length that counts in its length measure.
LENGTH_SHARE = 75
TOP_K = 10
#: Bytes of text and number of documents in a shard, about.
SHARD_BYTES, SHARD_DOCS = 2 << 20, 16_384
#: Items and terms (with repeats) of a block of queries.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 65_536
#: Winners of tasks meet in so many parts of an item before they meet as one.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that end terms become blanks, A-Z their lower case; bytes of longer characters stay.
BYTES_OF_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "ids binary, no_id binary, terms array<binary>, starts binary, ordinals binary, impacts binary"


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in order."""
    whole = text.encode() if isinstance(text, str) else text or b""
    return whole.translate(BYTES_OF_TERMS).split()


def collection_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for piece in pieces_of(batch):
                lengths = [len(terms_of(text)) for text in piece.column(0).to_pylist()]
                n_docs += sum(map(bool, lengths))
                n_terms += sum(lengths)
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["docs", "terms"])
        released()

    texts = docs.select(F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    got = texts.mapInArrow(counted, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def impacts_of(tf: np.ndarray, length_measure: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * length_measure)).astype(np.int32)


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The stored index of documents (doc_id, text), one row per shard, and the number of its documents."""
    n_docs, n_terms = collection_size(docs)
    return stored(index_shards(docs, n_docs, n_terms), "lexical-index"), n_docs


def index_shards(docs: DataFrame, n_docs: int, n_terms: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    def shard(ids: list[int | None], counts: list[Counter], lengths: list[int]) -> tuple:
        terms = sorted(set(chain.from_iterable(counts)))
        number = dict(zip(terms, range(len(terms)), strict=True))
        of_doc = np.fromiter(map(len, counts), np.int64, len(counts))
        total = int(of_doc.sum())
        term = np.fromiter(map(number.__getitem__, chain.from_iterable(counts)), np.int64, total)
        tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, total)
        # Lengths times counts may pass 64 bits before they are divided.
        measure = np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms for n in lengths], np.int64)
        ordinal = np.repeat(np.arange(len(counts)), of_doc)
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        impacts = impacts_of(tf, np.repeat(measure, of_doc))[order]
        return (
            np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array([i is None for i in ids], np.bool_).tobytes(),
            terms,
            starts.astype(np.int64).tobytes(),
            ordinal[order].astype(np.int32).tobytes(),
            impacts.tobytes(),
        )

    def shards(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids, counts, lengths, held = [], [], [], 0
        for doc_id, text in rows:
            terms = terms_of(text)
            if not terms:
                continue
            if ids and (held + len(text) > shard_bytes or len(ids) >= SHARD_DOCS):
                yield shard(ids, counts, lengths)
                ids, counts, lengths, held = [], [], [], 0
            ids.append(doc_id)
            counts.append(Counter(terms))
            lengths.append(len(terms))
            held += len(text)
        if ids:
            yield shard(ids, counts, lengths)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    return map_rows(texts, shards, INDEX, batch_rows=1)


def query_blocks(items: DataFrame, max_items: int = BLOCK_ITEMS, max_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, dict[bytes, int]]]]:
    """(item_id, terms with their repeats) in blocks, read partition by partition; rows of one id are one item."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM})"))
    counts = items.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").count().orderBy("item_id")
    block, held = [], 0
    for item_id, rows in groupby(counts.toLocalIterator(), key=lambda r: r["item_id"]):
        terms = {r["term"].encode(): r["count"] for r in rows}
        if block and (len(block) >= max_items or held + len(terms) > max_terms):
            yield block
            block, held = [], 0
        block.append((item_id, terms))
        held += len(terms)
    if block:
        yield block


def document_frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the terms of a block."""
    wanted = pa.array(terms, pa.binary())
    ddl = "number int, docs long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for held, starts in zip(batch.column(0), batch.column(1), strict=True):
                at, there = places_of(wanted, held.values)
                docs[there] += np.diff(np.frombuffer(starts.as_py(), np.int64))[at]
        (found,) = np.nonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(docs[found])], names=["number", "docs"])
        released()

    got = index.select("terms", "starts").mapInArrow(counted, ddl).groupBy("number").agg(F.sum("docs").alias("docs"))
    return {terms[r["number"]]: r["docs"] for r in got.toLocalIterator()}


def places_of(wanted: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted terms lie among those of a shard: (place, number among the wanted) of each that is there."""
    at = pc.index_in(held, value_set=wanted).to_numpy(zero_copy_only=False)
    (place,) = np.nonzero(~np.isnan(at)) if at.dtype.kind == "f" else (np.arange(len(at)),)
    return place, at[place].astype(np.int64)


def weight_of(docs_with_term: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs_with_term + 1)))


def best(scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, highest first, ties by id (null first): the whole tie is looked at."""
    if len(scores) > k:
        least = scores[np.argpartition(-scores, k - 1)[k - 1]]
        (found,) = np.nonzero(scores >= max(least, 1))
    else:
        (found,) = np.nonzero(scores > 0)
    return found[np.lexsort((ids[found], ~no_id[found], -scores[found]))][:k]


def search_block(index: DataFrame, block: list[tuple[int, dict[bytes, int]]], n_docs: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each item, of each task."""
    terms = sorted({t for _, q in block for t in q})
    frequencies = document_frequencies(index, terms)
    weights = [weight_of(frequencies[t], n_docs) if t in frequencies else 0 for t in terms]
    number = {t: i for i, t in enumerate(terms)}
    wanted = pa.array(terms, pa.binary())
    items = [i for i, _ in block]
    asked = [[(number[t], weights[number[t]] * n) for t, n in q.items() if weights[number[t]]] for _, q in block]
    ddl = "item_id long, doc_id long, score long"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won: list[list[np.ndarray]] = [[] for _ in items]
        for batch in batches:
            for one in pieces_of(batch, 1):
                ids, no_id, starts, ordinals, impacts = (np.frombuffer(one.column(c)[0].as_py(), t) for c, t in zip(("ids", "no_id", "starts", "ordinals", "impacts"), (np.int64, np.bool_, np.int64, np.int32, np.int32), strict=True))
                place, there = places_of(wanted, one.column("terms")[0].values)
                where = dict(zip(there.tolist(), place.tolist(), strict=True))
                scores = np.zeros(len(ids), np.int64)
                for i, q in enumerate(asked):
                    hit = False
                    for t, weight in q:
                        if (p := where.get(t)) is not None:
                            a, b = starts[p], starts[p + 1]
                            scores[ordinals[a:b]] += weight * impacts[a:b].astype(np.int64)
                            hit = True
                    if not hit:
                        continue
                    top = best(scores, no_id, ids, k)
                    won[i] = merged([*won[i], np.stack([scores[top], no_id[top].astype(np.int64), ids[top]])], k)
                    scores[:] = 0
        n = [w[0].shape[1] if w else 0 for w in won]
        rows = np.concatenate([w[0] for w in won if w], axis=1) if any(n) else np.zeros((3, 0), np.int64)
        doc_ids = pa.array(rows[2], pa.int64(), mask=rows[1].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))), doc_ids, pa.array(rows[0])], names=["item_id", "doc_id", "score"])
        released()

    return index.mapInArrow(found, ddl)


def merged(parts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best columns of (score, no id, id) arrays."""
    rows = np.concatenate(parts, axis=1)
    return [rows[:, best(rows[0], rows[1].astype(bool), rows[2], k)]]


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = TOP_K, max_items: int = BLOCK_ITEMS, max_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item (item_id, text)."""
    spark, parts = index.sparkSession, None
    for block in query_blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), max_items, max_terms):
        one = search_block(index, block, n_docs, k)
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    in_order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    salted = parts.withColumn("salt", F.spark_partition_id() % SALTS)
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*in_order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*in_order))).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index, n_docs = build_index(docs)
    return search(index, table(spark, sf_dir, "benchmark"), n_docs)


OP13_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM cut WHERE len(terms) > 0),
sizes AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::HUGEINT AS n_terms FROM docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
times AS (SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY ALL),
occurring AS (SELECT r, unnest(terms) AS term FROM docs),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM occurring WHERE term IN (SELECT term FROM times) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, sizes GROUP BY term),
scored AS (
  SELECT t.item_id, d.doc_id, d.r, sum(t.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * d.n::HUGEINT * s.n_docs) // s.n_terms))))::BIGINT AS score
  FROM times t JOIN postings p USING (term) JOIN weights w USING (term) JOIN docs d ON d.r = p.r, sizes s
  GROUP BY t.item_id, d.doc_id, d.r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
