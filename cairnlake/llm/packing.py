"""Packing documents into fixed-length sequences: shortest-pack-first over the histogram of lengths.

Documents become token ids and are cut only where they exceed a sequence. The histogram of piece lengths (at most
``seq_len`` bins, whatever the input) is packed on the driver: lengths are placed longest first, each into the open
patterns with the most room, which updates how often each pattern occurs; where none has room, new patterns open,
holding as many of that length as fit. Patterns then meet the pieces by rank within length. Ranks are counted in salted
groups of a length, dealt by a row number that is stored with the pieces, so neither a length that a third of all rows
have nor one row that repeats without end is ranked in one task.

Defined results: null and empty texts are the one closing id; a null doc_id stays null and its pieces are ranked like
others; rows that repeat are packed as often as they occur; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces_of, released, stored, table, worker_cache

SEQ_LEN = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, in each of two generations.
CACHE_WORDS = 150_000
#: Pieces of one length that are ranked together, about.
RANKED_TOGETHER = 500_000

#: Bytes of texts that are encoded at a time.
TEXT_AT_A_TIME = 4 << 20

PUNCTUATION = ".,;:!?%$#&*|"
#: The letters of Latin-1: the tokenizer lowers them as Arrow does and changes nothing else.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LATIN_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one above U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder(dict):
    """Ids of blank-separated words as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokens never span white space, its normaliser maps characters on their own but for composition,
    which a blank ends, and it drops white space. So the ids of a text are those of its words in order, and the ids of
    Latin-1 letters with punctuation after them are those of the lowered letters and of the punctuation. Arrow splits a
    batch of texts, numbers its words and takes them apart; only distinct parts are looked up or encoded, and ids are
    gathered by the numbers. This maps parts to ids; other words are encoded as they are.
    """

    def __init__(self, name: str):
        super().__init__()
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.characters = byte_characters()
        self.before: dict[str, bytes] = {}  # the parts of the last generation: those still in use are kept on

    def __missing__(self, part: str) -> bytes:
        """A part is what the tokenizer would neither change nor cut before its merges."""
        found = self.before.get(part)
        if found is None:
            plain = part if part.isascii() else part.encode().decode("latin-1").translate(self.characters)
            found = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        if len(part) <= 64:
            if len(self) >= CACHE_WORDS:
                self.before = self.copy()
                self.clear()
            self[part] = found
        return found

    def ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each word has)."""
        letters = pc.utf8_rtrim(words, PUNCTUATION)
        simple = pc.match_substring_regex(letters, f"^[{LATIN}]*$")
        cores = pc.utf8_lower(pc.if_else(simple, letters, "")).dictionary_encode()
        tails = pc.if_else(simple, pc.utf8_ltrim(words, LATIN_LETTERS), "").dictionary_encode()
        odd = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        found = [self[x] if x else b"" for part in (cores, tails) for x in part.dictionary.to_pylist()]
        found += [array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in words.take(pa.array(odd)).to_pylist()]
        number = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + len(cores.dictionary)], axis=1)
        number[odd] = 0
        length = np.array([len(x) // 4 for x in found], np.int64)
        parts = length[number]
        # A word that is not simple has one part, its second, so the first has no ids.
        number[odd, 1] = np.arange(len(found) - len(odd), len(found))
        parts[odd, 0], parts[odd, 1] = 0, length[len(found) - len(odd) :]
        return gathered(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(length) - length)[number.ravel()], parts.ravel()), parts.sum(axis=1)

    def encode_all(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end)."""
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        numbered = words.flatten().dictionary_encode()
        flat, length = self.ids_of_words(numbered.dictionary)
        number = numbered.indices.to_numpy()
        n = length[number]
        stops = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
        return gathered(flat, (np.cumsum(length) - length)[number], n), np.concatenate([[0], np.cumsum(n)])[stops]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()


def gathered(values: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` values from each of ``begins``, in a row."""
    return values[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())]


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``seq_len`` ids; ``with_ids`` adds the ids themselves."""
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    arrow = pa.schema(kinds + [("ids", pa.list_(pa.int64()))] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"words of {tokenizer}", lambda: WordEncoder(tokenizer))
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for some in pieces_of(batch, TEXT_AT_A_TIME):
                ids, begins = encoder.encode_all(pc.fill_null(some.column("text"), ""))
                rows = []
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), begins[:-1], begins[1:], strict=True):
                    own = np.append(ids[a:b], end)
                    for start in range(0, len(own), seq_len):
                        cut = own[start : start + seq_len]
                        row = (doc_id, start, len(cut), zlib.crc32(cut.tobytes()), len(own))
                        rows.append((*row, cut.astype("i8")) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        released()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(pieces, PIECE + ", ids array<long>" * with_ids)


def pack_histogram(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how often, runs of (length, repeats)); the lengths of a pattern add up to ``seq_len`` at most."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in range(seq_len, length - 1, -1):  # the shortest packs first
            while left and room.get(free):
                count, runs = room[free].pop()
                fit = free // length
                full = min(count, left // fit)
                if full:
                    room[free - fit * length].append((full, [*runs, (length, fit)]))
                    left, count = left - full * fit, count - full
                if count and left:  # fewer are left than one pack takes
                    room[free - left * length].append((1, [*runs, (length, left)]))
                    left, count = 0, count - 1
                if count:
                    room[free].append((count, runs))
            if not left:
                break
        if left:
            fit = seq_len // length
            if left // fit:
                room[seq_len - fit * length].append((left // fit, [(length, fit)]))
            if left % fit:
                room[seq_len - left % fit * length].append((1, [(length, left % fit)]))
    return [pattern for free in sorted(room) for pattern in room[free]]


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, repeats, first sequence, offset): pieces of that length by rank."""
    slots, used, sequence = defaultdict(list), defaultdict(int), 0
    for count, runs in patterns:
        offset = 0
        for length, repeats in runs:
            slots[length].append((used[length], repeats, sequence, offset))
            used[length] += count * repeats
            offset += length * repeats
        sequence += count
    return {k: np.asarray(v, "i8") for k, v in slots.items()}


def pack_pieces(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    The slots that tasks get are bounded by the histogram: a few runs for each of at most ``seq_len`` lengths.
    """
    numbered = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(32, sum(histogram.values()) // RANKED_TOGETHER)
    slots = slots_of(pack_histogram(histogram, seq_len))
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    counts = counts.select("length", "salt", before.alias("before"))
    ranked = salted.withColumn("in_salt", F.row_number().over(W.partitionBy("length", "salt").orderBy("row")).cast("long") - 1).join(counts, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("in_salt")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), "i8"), np.zeros(len(batch), "i8")
            ranks, lengths = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(batch) else []:
                length = int(lengths[at[0]])
                own = slots[length]
                slot = own[np.searchsorted(own[:, 0], ranks[at], "right") - 1]
                nth = ranks[at] - slot[:, 0]
                sequence[at] = slot[:, 2] + nth // slot[:, 1]
                offset[at] = slot[:, 3] + nth % slot[:, 1] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents and where they lie; ``with_ids`` keeps the ids."""
    return pack_pieces(token_pieces(docs, tokenizer, seq_len, with_ids), seq_len)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.withColumn("length", F.col("length").cast("long"))
