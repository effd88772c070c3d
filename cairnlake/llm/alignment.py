"""Alignment of two tokenizers over a corpus: postings of token pairs, cogrouped by the id of the first side.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends; tokens whose byte ranges overlap are linked;
and a pair of ids counts in every document that links it. Three passes over stored tables:

1. Texts become *blocks* of documents. Texts fall into segments at single blanks and line ends, where neither tokenizer
   can join what lies on the two sides, so only a block's distinct segments are tokenized and aligned, once per worker
   while they are remembered; documents gather them by number. A block yields its documents, its *postings* (per id of
   the first side: partner, document, multiplicity) and a task its partial *counts* of pairs.
2. Postings cogroup: counts and postings are shuffled by the id of the first side into sorted streams, which Spark spills;
   a task reads an id's counts (at most one per id of the second side), adds them up, takes the maximum, then lets the
   postings of the id stream past and emits what they contribute to each document. An id with more than
   ``SPLIT_POSTINGS`` postings is split by block into salted streams, each of which gets the id's counts too; the salts
   are known from one total per id, of which there are no more than the vocabulary has.
3. Contributions are shuffled by block, meet the block's documents and are summed by document.

Tasks hold one block, one id's counts and a bounded buffer of contributions, whatever the corpus and its hottest id hold.

Defined results: null and empty texts, and texts whose tokens do not give their bytes back (the piece model turns U+2581
into a blank), have no tokens: zeros and an empty string; null and repeated ids are documents of their own; an empty
table gives no rows; other columns are ignored. A text of any length is one document of a block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, released, scratch_path, table, worker_cache

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts in a block, about.
BLOCK_BYTES = 4 << 20
#: Bytes of segments and of what is known of them that a worker remembers, about.
CACHED_BYTES = 96 << 20
#: Pairs whose counts a task holds, and contributions that it holds, before it lets them go.
HELD_COUNTS, HELD_SHARES = 2_000_000, 1_000_000
#: Postings of an id that one stream takes.
SPLIT_POSTINGS = 4_000_000

#: The printable characters of the byte-level alphabet stand for themselves; the other bytes follow from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

BLOCKS = "kind int, block long, a int, n long, x binary, y binary, z binary, groups array<string>"
SHARES = "block long, docs binary, sums binary, bests binary"


class ByteLevel:
    """A byte-level BPE of the tokenizers library: ids of segments and the bytes of each id."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(_place(name))
        self.tokenizer.encode_special_tokens = True
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = [b""] * size
        for token, number in self.tokenizer.get_vocab().items():
            self.bytes_of[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte fallback, which puts a blank before what it encodes."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=_place(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, segments: list[str]) -> list[list[int]]:
        """A segment that begins with a blank loses it to the model's own; before another, the model's own goes."""
        blank = [s.startswith(" ") for s in segments]
        got = self.model.encode([s[1:] if b else s for s, b in zip(segments, blank, strict=True)], num_threads=1)
        return [ids if b else ids[1:] for ids, b in zip(got, blank, strict=True)]


def _place(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def segment_starts(texts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where segments begin in the bytes of texts that lie one after another, each with a blank before it.

    A text begins one; so does a blank or a line end between two characters that are surely not white space.
    """
    padded = np.concatenate([np.zeros(3, np.uint8), texts, np.full(3, 32, np.uint8)])
    (at,) = np.nonzero((texts == 32) | (texts == 10))
    a, b, c, d, e = (padded[at + i] for i in (0, 1, 2, 4, 5))
    alone = ~_blank(c) & ~_blank(d) & ~_wide_blank(a, b) & ~_wide_blank(b, c) & ~_wide_blank(d, e)
    return np.union1d(at[alone], begins)


def _blank(byte: np.ndarray) -> np.ndarray:
    return (byte <= 32) | (byte == 127)


def _wide_blank(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a character with these first two bytes may be white space."""
    wide = ((first == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((first == 0xE1) & ((second == 0x9A) | (second == 0xA0)))
    return wide | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``begins``, one after another."""
    upto = np.cumsum(lengths)
    if not len(upto) or not upto[-1]:
        return values[:0]
    return values[np.arange(upto[-1]) + np.repeat(begins - (upto - lengths), lengths)]


@dataclass
class Segments:
    """What a worker knows of segments, by number."""

    number: dict[bytes, int] = field(default_factory=dict)
    n_first: list[int] = field(default_factory=list)
    n_second: list[int] = field(default_factory=list)
    n_groups: list[int] = field(default_factory=list)
    whole: list[bool] = field(default_factory=list)
    #: ``a1,a2|b1;`` for each group, and the codes of the linked pairs, in order.
    groups: list[bytes] = field(default_factory=list)
    pairs: list[bytes] = field(default_factory=list)
    held: int = 0


class Aligner:
    """Segments of texts to groups and pairs of the ids of two tokenizers."""

    def __init__(self, first: str, second: str):
        self.sides = (ByteLevel(first), Pieces(second))
        self.lengths = [np.array([len(b) for b in s.bytes_of], np.int64) for s in self.sides]
        self.n_second = len(self.sides[1].bytes_of)
        told = [[b"%d," % i for i in range(len(s.bytes_of))] + [b"%d%b" % (i, end) for i in range(len(s.bytes_of))] for s, end in zip(self.sides, (b"|", b";"), strict=True)]
        self.told = np.array(told[0] + told[1], object)
        self.known = Segments()

    def learn(self, segments: list[bytes]) -> None:
        """Tokenizes and aligns segments that are not known."""
        k, texts, whole = self.known, [s.decode() for s in segments], np.ones(len(segments), bool)
        sizes = np.array([len(s) for s in segments], np.int64)
        base = np.cumsum(sizes) - sizes
        found = [side.encode(texts) for side in self.sides]
        for side, ids in zip(self.sides, found, strict=True):
            whole &= [b"".join(map(side.bytes_of.__getitem__, mine)) == s for mine, s in zip(ids, segments, strict=True)]
        counts = [np.array([len(mine) for mine in ids], np.int64) * whole for ids in found]
        kept = [np.fromiter((x for mine, w in zip(ids, whole.tolist(), strict=True) if w for x in mine), np.int64) for ids in found]
        ends = [_ends(lengths[i], n, base) for lengths, i, n in zip(self.lengths, kept, counts, strict=True)]
        cuts = np.union1d(*ends)
        # Between two cuts lies the overlap of one token of each side.
        codes = kept[0][np.searchsorted(ends[0], cuts)] * self.n_second + kept[1][np.searchsorted(ends[1], cuts)]
        links = np.diff(np.searchsorted(cuts, np.concatenate([base, [sizes.sum()]]), "right"))
        common = np.intersect1d(*ends, assume_unique=True)
        n_groups = np.diff(np.searchsorted(common, np.concatenate([base, [sizes.sum()]]), "right"))
        # Tokens in the order in which groups tell them: group by group, the first side's before the second's.
        last = [np.isin(e, common, assume_unique=True) for e in ends]
        group = [np.searchsorted(common, e) for e in ends]
        n_ids = len(self.lengths[0])
        tokens = np.concatenate([kept[0] + n_ids * last[0], 2 * n_ids + kept[1] + self.n_second * last[1]])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        told = self.told[tokens[order]].tolist()
        at_token, at_pair = 0, 0
        for i, s in enumerate(segments):
            n = int(counts[0][i] + counts[1][i])
            k.number[s] = len(k.groups)
            k.groups.append(b"".join(told[at_token : at_token + n]))
            k.pairs.append(codes[at_pair : at_pair + links[i]].tobytes())
            k.held += len(s) + len(k.groups[-1]) + len(k.pairs[-1]) + 300  # and what Python adds
            at_token += n
            at_pair += int(links[i])
        k.n_first += counts[0].tolist()
        k.n_second += counts[1].tolist()
        k.n_groups += n_groups.tolist()
        k.whole += whole.tolist()

    def block(self, texts: list[bytes], digest: bool) -> dict:
        """Documents, and (document, pair, multiplicity) in three arrays ordered by pair, of texts that are not empty."""
        said = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        starts = segment_starts(said, begins)
        offsets = np.concatenate([starts, [len(said)]]).astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(said)]).dictionary_encode()
        distinct, used = cut.dictionary.to_pylist(), cut.indices.to_numpy().astype(np.int64)
        if self.known.held > CACHED_BYTES:
            self.known = Segments()
        if new := [s for s in distinct if s not in self.known.number]:
            self.learn(new)
        k, numbers = self.known, [self.known.number[s] for s in distinct]
        of = lambda values, kind: np.array([values[i] for i in numbers], kind)
        first_of_doc = np.searchsorted(starts, begins)
        total = lambda values: np.add.reduceat(values[used], first_of_doc)
        whole = np.logical_and.reduceat(of(k.whole, bool)[used], first_of_doc)
        n_first, n_second, n_groups = (total(of(v, np.int64)) * whole for v in (k.n_first, k.n_second, k.n_groups))
        told, upto, shown = [k.groups[i] for i in numbers], [*first_of_doc[1:].tolist(), len(used)], used.tolist()
        groups = [b"".join([told[s] for s in shown[a:b]])[:-1] if w else b"" for a, b, w in zip(first_of_doc.tolist(), upto, whole.tolist(), strict=True)]
        groups = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in groups]
        # Segments of a document with their repeats, then the pairs of those.
        n_distinct = len(distinct)
        doc_of = np.repeat(np.arange(len(texts)), np.diff([*first_of_doc, len(used)]))
        keep = whole[doc_of]
        keys, times = np.unique(doc_of[keep] * n_distinct + used[keep], return_counts=True)
        pairs = [k.pairs[i] for i in numbers]
        n_pairs = np.array([len(p) // 8 for p in pairs], np.int64)
        flat = np.frombuffer(b"".join(pairs), np.int64)
        segment, doc = keys % n_distinct, keys // n_distinct
        lengths = n_pairs[segment]
        codes = gathered(flat, (np.cumsum(n_pairs) - n_pairs)[segment], lengths)
        code_order = codes * len(texts) + np.repeat(doc, lengths)
        order = np.argsort(code_order, kind="stable")
        code_order, weight = code_order[order], np.repeat(times, lengths)[order]
        edge = np.flatnonzero(np.diff(code_order, prepend=-1)) if len(code_order) else np.zeros(0, np.int64)
        return {
            "n_a": n_first, "n_b": n_second, "n_groups": n_groups, "groups": groups,
            "doc": code_order[edge] % len(texts), "code": code_order[edge] // len(texts), "times": np.add.reduceat(weight, edge) if len(edge) else weight,
        }


def _ends(lengths: np.ndarray, counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Where tokens end in the bytes of segments that lie one after another; segments without tokens are stepped over."""
    upto, first = np.cumsum(lengths), np.cumsum(counts) - counts
    before = np.concatenate([[0], upto])[first]
    return upto + np.repeat(base - before, counts)


def stored_blocks(docs: DataFrame, first: str = FIRST, second: str = SECOND, digest: bool = False) -> str:
    """Writes the blocks of documents (doc_id, text) to the shared folder, by kind: 0 counts, 1 postings, 2 documents."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, nth = worker_cache(f"aligner {first} {second}", lambda: Aligner(first, second)), TaskContext.get().partitionId() << 32
        codes, counts = [], []
        for batch in batches:
            for piece in pieces_of(batch, BLOCK_BYTES):
                ids, texts = piece.column(0), piece.column(1).to_pylist()
                (filled,) = np.nonzero([bool(t) for t in texts])
                n = len(texts)
                rows = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups")}
                groups = [""] * n
                if len(filled):
                    got = aligner.block([texts[i] for i in filled], digest)
                    for c in rows:
                        rows[c][filled] = got[c]
                    for i, g in zip(filled.tolist(), got["groups"], strict=True):
                        groups[i] = g
                    yield from _postings(nth, filled[got["doc"]], got["code"], got["times"], aligner.n_second)
                    found, docs_of = np.unique(got["code"], return_counts=True)
                    codes.append(found)
                    counts.append(docs_of)
                    if sum(map(len, codes)) > HELD_COUNTS:
                        codes, counts = _added(codes, counts)
                        if len(codes[0]) > HELD_COUNTS // 2:
                            yield from _counts(codes[0], counts[0], aligner.n_second)
                            codes, counts = [], []
                none = np.array(ids.is_null())
                numbers = np.concatenate([none.astype(np.int64), ids.fill_null(0).to_numpy().astype(np.int64)])
                yield _rows(kind=2, block=[nth], n=[n], x=[numbers.tobytes()], y=[np.concatenate([rows[c] for c in rows]).tobytes()], groups=[groups])
                nth += 1
        if codes:
            codes, counts = _added(codes, counts)
            yield from _counts(codes[0], counts[0], aligner.n_second)
        released()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    path = scratch_path(docs.sparkSession, "aligned-blocks")
    texts.mapInArrow(blocks, BLOCKS).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return [found], [total]


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"kind": pa.int32(), "block": pa.int64(), "a": pa.int32(), "n": pa.int64(), "x": pa.binary(), "y": pa.binary(), "z": pa.binary(), "groups": pa.list_(pa.string())}
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))


def _counts(codes: np.ndarray, counts: np.ndarray, n_second: int) -> Iterator[pa.RecordBatch]:
    """Kind 0, a row per id: partners and in how many documents they are linked."""
    a, b = codes // n_second, (codes % n_second).astype(np.int32)
    edge = np.flatnonzero(np.diff(a, prepend=-1))
    upto = [*edge[1:].tolist(), len(a)]
    yield _rows(0, a=a[edge], n=np.add.reduceat(counts, edge), x=[b[i:j].tobytes() for i, j in zip(edge.tolist(), upto, strict=True)], y=[counts[i:j].tobytes() for i, j in zip(edge.tolist(), upto, strict=True)])


def _postings(block: int, doc: np.ndarray, codes: np.ndarray, times: np.ndarray, n_second: int) -> Iterator[pa.RecordBatch]:
    """Kind 1, a row per id and block: partners, documents and multiplicities."""
    if not len(codes):
        return
    a, b = codes // n_second, (codes % n_second).astype(np.int32)
    doc, times = doc.astype(np.int32), times.astype(np.int32)
    edge = np.flatnonzero(np.diff(a, prepend=-1))
    upto = [*edge[1:].tolist(), len(a)]
    runs = list(zip(edge.tolist(), upto, strict=True))
    yield _rows(1, block=np.full(len(edge), block), a=a[edge], n=np.diff([*edge, len(a)]), x=[b[i:j].tobytes() for i, j in runs], y=[doc[i:j].tobytes() for i, j in runs], z=[times[i:j].tobytes() for i, j in runs])


def hot_ids(postings: DataFrame, split: int = SPLIT_POSTINGS) -> dict[int, int]:
    """Salts of the ids that have more postings than one stream takes; no more rows than the vocabulary has ids."""
    totals = postings.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > split)
    return {r["a"]: -(-r["n"] // split) for r in totals.collect()}


def shares(counts: DataFrame, postings: DataFrame, n_second: int, split: int = SPLIT_POSTINGS) -> DataFrame:
    """What each stream of an id contributes to documents: links times their counts, and links with the id's highest."""
    salts = hot_ids(postings, split)
    n_salts = F.lit(1)
    if salts:
        known = F.create_map(*[F.lit(x) for pair in sorted(salts.items()) for x in pair])
        n_salts = F.coalesce(F.element_at(known, F.col("a")), F.lit(1))
    none = F.lit(None).cast("binary")
    dealt = counts.select("a", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("salt"), F.lit(0).alias("tag"), F.lit(None).cast("long").alias("block"), "x", "y", none.alias("z"))
    dealt = dealt.unionByName(postings.select("a", F.pmod(F.xxhash64("block"), n_salts).cast("int").alias("salt"), F.lit(1).alias("tag"), "block", "x", "y", "z"))
    streams = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "tag", "block")

    def contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, stream, highest, seen = np.zeros(n_second, np.int64), None, None, []
        held, n_held = {}, 0
        for batch in batches:
            for a, salt, tag, block, x, y, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = np.frombuffer(x, np.int32)
                if (a, salt) != stream:
                    for old in seen:
                        count[old] = 0
                    stream, highest, seen = (a, salt), None, []
                if tag == 0:
                    count[b] += np.frombuffer(y, np.int64)
                    seen.append(b)
                    if len(seen) > 64:
                        seen = [np.unique(np.concatenate(seen))]
                    continue
                if highest is None:
                    highest = max(int(count[old].max()) for old in seen)
                times = np.frombuffer(z, np.int32).astype(np.int64)
                found = count[b]
                held.setdefault(block, []).append((np.frombuffer(y, np.int32), times * found, times * (found == highest)))
                n_held += len(b)
                if n_held > HELD_SHARES:
                    yield _summed(held)
                    held, n_held = {}, 0
        if held:
            yield _summed(held)
        released()

    return streams.mapInArrow(contributed, SHARES)


def _summed(held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    rows = []
    for parts in held.values():
        docs, sums, bests = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(docs, kind="stable")
        edge = np.flatnonzero(np.diff(docs[order], prepend=-1))
        rows.append((docs[order][edge].tobytes(), np.add.reduceat(sums[order], edge).tobytes(), np.add.reduceat(bests[order], edge).astype(np.int32).tobytes()))
    docs, sums, bests = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(docs), pa.array(sums), pa.array(bests)], names=["block", "docs", "sums", "bests"])


def summed_by_document(documents: DataFrame, contributions: DataFrame) -> DataFrame:
    """A block's documents and all that streams contributed to them, one block at a time."""
    none = F.lit(None).cast("binary")
    rows = documents.select("block", F.lit(0).alias("tag"), "n", "x", "y", none.alias("z"), "groups")
    some = contributions.select("block", F.lit(1).alias("tag"), F.lit(None).cast("long").alias("n"), F.col("docs").alias("x"), F.col("sums").alias("y"), F.col("bests").alias("z"), F.lit(None).cast("array<string>").alias("groups"))
    dealt = rows.unionByName(some).repartition("block").sortWithinPartitions("block", "tag")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def finished(numbers, values, groups, n_best, count_sum) -> pa.RecordBatch:
        none, ids = numbers.reshape(2, -1)
        n_a, n_b, n_groups = values.reshape(3, -1)
        columns = [pa.array(ids, pa.int64(), mask=none.astype(bool)), n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum]
        return pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns), groups], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(len(batch)):
                _, tag, n, x, y, z, groups = (c[i] for c in batch.columns)
                if tag.as_py() == 0:
                    if held:
                        yield finished(*held)
                    n = n.as_py()
                    held = (np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), groups.values, np.zeros(n, np.int64), np.zeros(n, np.int64))
                else:
                    docs = np.frombuffer(x.as_py(), np.int32)
                    held[4][docs] += np.frombuffer(y.as_py(), np.int64)
                    held[3][docs] += np.frombuffer(z.as_py(), np.int32)
        if held:
            yield finished(*held)
        released()

    return dealt.mapInArrow(summed, ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c in names))


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND, digest: bool = False, split: int = SPLIT_POSTINGS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of documents (doc_id, text).

    ``groups`` are the aligned ids, ``a1,a2|b1;a3|b2,b3``, or with ``digest`` their sha256.
    """
    spark, path = docs.sparkSession, stored_blocks(docs, first, second, digest)
    kinds = spark.read.schema(BLOCKS).parquet(path)
    counts, postings, documents = (kinds.where(F.col("kind") == k) for k in range(3))
    return summed_by_document(documents, shares(counts, postings, len(Pieces(second).bytes_of), split))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
