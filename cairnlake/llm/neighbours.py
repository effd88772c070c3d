"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes are signs of centred vectors under learned rotations: principal axes, turned until they lie nearest to their own
signs (iterative quantisation), several times from different starts until there are ``code_bits`` bits. A code is cut
into substrings of about as many bits as it takes to tell a shard's rows apart, and each substring has its own index. A
query probes, in every index, all values within a few bits: with radius = s * substrings + a, those within s bits in the
first a + 1 indexes and within s - 1 in the others. By the pigeonhole principle every code within the radius is among the
rows that probes meet. These are checked by their whole codes and reranked by exact distances on the original vectors; all
rows of a result come out of the indexes. The first radius holds half of all neighbours; it grows, a bit in every
substring at a time, until it holds ``k`` candidates of the shard or none is left. The angle of the ``k``-th of these tells
how many bits a neighbour may differ in - its share of all bits and a learned multiple of the spread - and the search
ends there.

Vectors are dealt into cells by their nearest centre, so that a query meets only the cells that are near to it: as many
as hold ``CELL_RECALL`` of the neighbours within the sample. Cells are split into shards of ``SHARD`` rows
about, however large one is, and the queries of a cell into blocks of ``QUERY_BLOCK``; a task holds one shard's index and
one block and hands on the ``k`` nearest of each query only. So rows are copied once for each block of queries that asks
their cell, and queries once for each shard of their cells. A query that finds fewer than ``k`` rows in its cells asks
all of them.

The rotations, the centres and the radius are learned from a sample of ``SAMPLE`` vectors, in large tables 16 times the
square root of their rows and at most ``MOST_SAMPLE`` (those whose ids hash lowest), so that cells, of which there is one
for 16 vectors of the sample at most, grow with the square root of the rows: the multiple is the one that finds ``SAMPLE_RECALL`` of the sample's own nearest neighbours. Every vector is indexed. Vectors without any structure are the worst case: their neighbours are hardly
nearer than others, so the radius is wide, probes meet most rows and all cells are near.

Defined results: vectors that are null, empty, zero, hold null or non-finite components or have another dimension than
most take no part, as query or as candidate; rows with the query's id are its own and no candidates; rows that repeat
are candidates each, and repeated queries count once; ties go to the smaller id; a query has ``k`` rows wherever there
are ``k`` candidates, else all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

K = 10
CODE_BITS = 128
SAMPLE, MOST_SAMPLE, SAMPLE_QUERIES, SAMPLE_RECALL = 8192, 65_536, 256, 0.97
ROUNDS = 30
SHARD, QUERY_BLOCK = 16_384, 32_768
#: Bits of a substring at most; its index has a place for every value.
SUBSTRING = 16
#: Each cell has so many sample rows at least.
SAMPLE_PER_CELL = 16
CELL_RECALL, CELL_ROUNDS = 0.99, 10
SEED = 7


@dataclass(frozen=True)
class Codes:
    """``rotation`` has a column per bit; ``radius`` is where searches begin."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int = 0
    margin: float = 0.0

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of bits for each vector."""
        return ((x - self.centre) @ self.rotation >= 0).astype(np.uint8)


    def asked(self, vector: np.ndarray, other: np.ndarray) -> int:
        """In how many bits those may differ that are as near to a vector as another is."""
        mean, spread = self.differing(vector, other)
        return int(np.ceil(mean + self.margin * spread))

    def differing(self, vector: np.ndarray, other: np.ndarray) -> tuple[float, float]:
        """In how many bits two vectors differ by their angle, and the spread of that, which is a bit at least."""
        n, share = self.rotation.shape[1], angle(vector - self.centre, other - self.centre) / np.pi
        return n * share, max(1.0, np.sqrt(n * share * (1 - share)))


def angle(a: np.ndarray, b: np.ndarray) -> float:
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.arccos(np.clip(a @ b / size, -1, 1))) if size > 0 else np.pi / 2


def learn_rotation(sample: np.ndarray, code_bits: int = CODE_BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    centre = sample.mean(axis=0)
    z = sample - centre
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    p, parts, have = z @ axes, [], 0
    while have < code_bits:
        r = np.linalg.qr(rng.normal(size=(p.shape[1], p.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(p.T @ np.where(p @ r >= 0, 1.0, -1.0))
            r = u @ vt
        parts.append(axes @ r)
        have += p.shape[1]
    return centre, np.concatenate(parts, axis=1)[:, :code_bits]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    whole = np.packbits(bits, axis=-1)
    return np.pad(whole, [(0, 0)] * (whole.ndim - 1) + [(0, -whole.shape[-1] % 8)]).view(np.uint64)


def hamming(words: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ word).sum(axis=1, dtype=np.int32)


def learn(sample: np.ndarray, k: int = K, code_bits: int = CODE_BITS) -> Codes:
    plain = Codes(*learn_rotation(sample, code_bits))
    words, differing, beyond = packed(plain.encode(sample)), [], []
    for q in range(min(SAMPLE_QUERIES, len(sample)) if len(sample) > 1 else 0):
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        nearest = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        bits = hamming(words[nearest], words[q])
        differing.append(bits)
        mean, spread = plain.differing(sample[q], sample[nearest[-1]])
        beyond.append((bits - mean) / spread)
    if not differing:
        return Codes(plain.centre, plain.rotation, code_bits)
    return Codes(plain.centre, plain.rotation, int(np.median(np.concatenate(differing))), float(np.quantile(np.concatenate(beyond), SAMPLE_RECALL)))


def learn_centres(sample: np.ndarray, cells: int, rounds: int = CELL_ROUNDS) -> np.ndarray:
    """Centres by k-means; a centre that loses all its rows stays where it was."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        of = near_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        n = np.bincount(of, minlength=cells)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def near_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    for at in range(0, len(x), 4096):
        d = (centres**2).sum(axis=1) - 2 * x[at : at + 4096] @ centres.T
        out[at : at + 4096] = np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def learn_probes(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many cells hold ``CELL_RECALL`` of the neighbours that rows of the sample have there."""
    some = sample[:SAMPLE_QUERIES]
    order = near_cells(some, centres, len(centres))
    place = np.argsort(order, axis=1, kind="stable")
    of, ranks = near_cells(sample, centres, 1)[:, 0], []
    for q, x in enumerate(some):
        d = ((sample - x) ** 2).sum(axis=1)
        d[q] = np.inf
        ranks.append(place[q, of[np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]]])
    return int(np.ceil(np.quantile(np.concatenate(ranks), CELL_RECALL))) + 1


class MultiIndex:
    """One index per substring of bits: rows sorted by its value, and where each value begins."""

    def __init__(self, bits: np.ndarray):
        n, width = bits.shape
        self.words = packed(bits)
        length = int(np.clip(np.round(np.log2(max(n, 2))), 4, SUBSTRING))
        #: Bits of each substring.
        self.cuts = np.array_split(np.arange(width), -(-width // length))
        self.indexes = []
        for cut in self.cuts:
            values = self.value(bits, cut)
            rows = np.argsort(values, kind="stable")
            self.indexes.append((rows, np.searchsorted(values[rows], np.arange((1 << len(cut)) + 1))))
        #: For each length: all values by their number of bits, and how many have up to so many.
        self.flips = {}
        for size in {len(cut) for cut in self.cuts}:
            everything = np.arange(1 << size)
            order = everything[np.argsort(np.bitwise_count(everything), kind="stable")]
            self.flips[size] = order, np.searchsorted(np.bitwise_count(order), np.arange(size + 1), "right")

    @staticmethod
    def value(bits: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return bits[..., cut].astype(np.int64) @ (1 << np.arange(len(cut)))

    def probes(self, radius: int) -> list[int]:
        """How many values are probed in each index: those within s bits in the first a + 1, within s - 1 in the others."""
        s, a = divmod(radius, len(self.cuts))
        bits = [s if m <= a else s - 1 for m in range(len(self.cuts))]
        return [int(self.flips[len(cut)][1][min(b, len(cut))]) if b >= 0 else 0 for b, cut in zip(bits, self.cuts, strict=True)]

    def marked(self, bits: np.ndarray, radius: int) -> np.ndarray:
        """The rows that the probes of a query meet."""
        seen = np.zeros(len(self.words), bool)
        for (rows, begins), cut, n_probes in zip(self.indexes, self.cuts, self.probes(radius), strict=True):
            probed = self.flips[len(cut)][0][:n_probes] ^ self.value(bits, cut)
            start, stop = begins[probed], begins[probed + 1]
            full = stop > start
            start, n = start[full], (stop - start)[full]
            seen[rows[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return np.flatnonzero(seen)

    def search(self, bits: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        rows = self.marked(bits, radius)
        return rows[hamming(self.words[rows], packed(bits)) <= radius]

    def search_until(self, bits: np.ndarray, radius: int, k: int, allowed: np.ndarray) -> tuple[np.ndarray, int]:
        """The allowed rows within the radius, or within the next wider one that has ``k`` (at last all), and that radius."""
        while True:
            rows = self.search(bits, radius)
            rows = rows[allowed[rows]]
            if len(rows) >= k or radius >= len(bits):
                return rows, radius
            radius = min(radius + len(self.cuts), len(bits))


def nearest_rows(index: MultiIndex, codes: Codes, x: np.ndarray, vector: np.ndarray, bits: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are reranked for a query, and their distances."""
    far = lambda rows: np.sqrt(((x[rows] - vector) ** 2).sum(axis=1))
    rows, reached = index.search_until(bits, codes.radius, k, allowed)
    score = far(rows)
    if len(rows) < k:
        return rows, score
    last = rows[np.argpartition(score, k - 1)[k - 1]]
    if (asked := min(codes.asked(vector, x[last]), len(bits))) > reached:
        rows = index.search(bits, asked)
        rows = rows[allowed[rows]]
        score = far(rows)
    return rows, score


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _with_cells(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """Adds ``cells``, the nearest ones of each row."""
    if len(centres) == 1:
        return vectors.withColumn("cells", F.array(F.lit(0)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = near_cells(_matrix(batch.column("embedding"), centres.shape[1]), centres, n)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * n, pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), cells], ["vec_id", "embedding", "cells"])

    return vectors.select("vec_id", "embedding").mapInArrow(dealt, "vec_id long, embedding array<double>, cells array<int>")


def _parts(rows: DataFrame, cells: int, size: int) -> list[int]:
    """Into how many parts of ``size`` rows each cell's rows go; there are as many counts as cells."""
    found = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [max(1, -(-found.get(c, 0) // size)) for c in range(cells)]


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = K, code_bits: int = CODE_BITS, sample_rows: int | None = None, shard_rows: int = SHARD, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each of ``queries`` among ``vectors``, both (vec_id, embedding)."""
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    spark, vectors, queries = vectors.sparkSession, plain(vectors), plain(queries)
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    vectors, queries = (df.where(F.size("embedding") == dim) for df in (vectors, queries))
    queries = queries.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample_rows = sample_rows or min(MOST_SAMPLE, max(SAMPLE, 16 * isqrt(n)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow()
    sample = _matrix(sample.column("embedding"), dim)
    codes = learn(sample, k, code_bits)
    cells = max(1, min(n // shard_rows, len(sample) // SAMPLE_PER_CELL))
    centres = learn_centres(sample, cells) if cells > 1 else sample.mean(axis=0)[None]
    probes = learn_probes(sample, centres, k) if cells > 1 else 1

    indexed = _with_cells(vectors, centres, 1).select("vec_id", "embedding", F.col("cells")[0].alias("cell"))
    if cells > 1:
        indexed = stored(indexed, "cells")
    shards = _parts(indexed, cells, shard_rows)

    def asked(some: DataFrame, n_cells: int) -> DataFrame:
        """The nearest of each of some queries in as many of its cells."""
        to = _with_cells(some, centres, n_cells).select("vec_id", "embedding", F.explode("cells").alias("cell"))
        blocks = _parts(to, cells, query_block)
        of = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("cell") + 1)
        every = lambda counts, name: F.explode(F.sequence(F.lit(0), of(counts) - 1)).alias(name)
        dealt = lambda counts, name: F.pmod(F.xxhash64("vec_id"), of(counts)).cast("int").alias(name)
        left = indexed.select("cell", dealt(shards, "shard"), every(blocks, "block"), "vec_id", "embedding")
        right = to.select("cell", every(shards, "shard"), dealt(blocks, "block"), "vec_id", "embedding")
        key = ["cell", "shard", "block"]
        near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(searched, "query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def searched(held: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(held) or not len(wanted):
            return out.empty_table()
        x, q = _matrix(held.column("embedding"), dim), _matrix(wanted.column("embedding"), dim)
        ids = held.column("vec_id").to_pandas().to_numpy()
        known = held.column("vec_id").is_valid().to_numpy()
        index, found = MultiIndex(codes.encode(x)), []
        for query_id, vector, code in zip(wanted.column("vec_id").to_pylist(), q, codes.encode(q), strict=True):
            rows, score = nearest_rows(index, codes, x, vector, code, k, known & (ids != query_id))
            order = np.lexsort((ids[rows], score))[:k]
            found.append((np.full(len(order), query_id), ids[rows[order]], score[order]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)).cast(t.type) for c, t in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    if probes >= cells:
        return asked(queries, cells)
    near = stored(asked(queries, probes), "neighbours")
    full = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    short = stored(queries.join(full, queries["vec_id"] == full["query_id"], "left_anti"), "short")
    if short.isEmpty():
        return near
    return near.join(full, "query_id", "left_semi").unionByName(asked(short, cells))


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
