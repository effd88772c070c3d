"""MinHash near-duplicates with min-max hashing, confirmed on whole shingle sets.

Under each of ``PERMUTATIONS`` hash permutations a document keeps both the smallest and the largest value of its
shingles: two signature values for one evaluation. The values are banded ``BAND_ROWS`` at a time (at a similarity of
0.8 a pair misses all bands once in three million); documents that share a band are candidates, and candidates whose
similarity on whole sets reaches the threshold are linked.

Equal sets are one class from the start, and only classes are banded. No bucket is expanded into its pairs: first, in
``STAR_ROUNDS`` rounds and in more as long as a round links ``FRUITFUL`` of the members, the members of a bucket are held
against one pivot, and linked ones fall into one component.
What remains are pairs of a bucket's members that lie in different components. They are compared in blocks of
signatures and of whole sets, all of them, and links among them are confirmed too. Pairs within one component need no
comparison, and a block hands on only pairs that hardly miss a link. So the components are those of all confirmed
candidate pairs, but for pairs whose sketches mislead: at a similarity of 0.8, where it is most, 2 in 100 million.

Words are split at blanks and U+0009..U+000D after lower-casing A-Z. A set is the distinct ``n_words``-word shingles, or
the whole sequence where there are fewer words. Shingles are 64-bit hashes of words, sets have 128-bit digests.

Defined results: null and empty texts have empty sets and link with nothing; a null doc_id takes part and gets the
component of its text (null if that has no id at all; such a row is kept); rows that repeat are rows of the result; rows
of one doc_id with different texts belong each to its own text's class; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rounds, map_rows, stored, table, worker_cache

N_WORDS = 4
#: Links reach this many hundredths of intersection to union.
THRESHOLD = 80
PERMUTATIONS = 95
BAND_ROWS = 5
STAR_ROUNDS = 2
#: A round of stars that links so large a share of the members is followed by another one.
FRUITFUL = 0.02
#: Members of a bucket that are compared at a time.
BLOCK = 1024
#: Estimates below the threshold less so many standard errors are not confirmed.
MARGIN = 6
#: Shingles whose values are worked on at a time.
AT_ONCE = 1 << 17
CACHE_WORDS = 250_000
SEED = 20240101


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: only A-Z change, only the six blanks split


def shingles(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_cache("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(n_words, len(words))
    out = np.full(len(h) - width + 1, width if len(words) < n_words else 0, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def min_max(sets: list[np.ndarray], n_permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row per (not empty) set: the smallest and the largest value under each permutation, side by side."""
    factors, offsets = permutations(n_permutations)
    out = np.empty((len(sets), 2 * n_permutations), np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    everything = np.concatenate(sets)
    value = np.empty_like(everything)
    for k, (a, b) in enumerate(zip(factors, offsets, strict=True)):
        np.multiply(everything, a, out=value)
        np.add(value, b, out=value)
        out[:, 2 * k] = np.minimum.reduceat(value, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(value, starts)
    return out


def band_keys(signatures: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    """One key per band; the number of the band is part of it."""
    bands = signatures.reshape(len(signatures), -1, band_rows)
    keys = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(band_rows):
        keys = _mixed(keys * np.uint64(0x9FB21C651E98DF25) + bands[:, :, k])
    return keys.view(np.int64)


def text_key(text: Column) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketched(docs: DataFrame, n_words: int = N_WORDS, n_permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, keys, sketch): digest, keys and sketch are null for an empty set.

    The sketch has a byte of each signature value, for estimates.
    """

    def several(some: list[tuple[int | None, int, np.ndarray]]) -> Iterator[tuple]:
        full = [s for *_, s in some if len(s)]
        if full:
            signatures = min_max(full, n_permutations)
            keys, sketches = band_keys(signatures, band_rows), (signatures >> np.uint64(13)).astype(np.uint8)
        at = 0
        for doc_id, key, s in some:
            if len(s):
                yield doc_id, key, len(s), xxhash.xxh3_128_digest(s.tobytes()), keys[at], sketches[at].tobytes()
                at += 1
            else:
                yield doc_id, key, 0, None, None, None

    def rows(got: Iterator[tuple]) -> Iterator[tuple]:
        some, n = [], 0
        for doc_id, key, text in got:
            some.append((doc_id, key, shingles(text, n_words)))
            n += len(some[-1][2])
            if n >= AT_ONCE:
                yield from several(some)
                some, n = [], 0
        yield from several(some)

    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), F.col("text").cast("string"))
    return map_rows(texts, rows, "doc_id long, text_key long, n_shingles long, digest binary, keys array<long>, sketch binary")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each id in links (a, b) reaches.

    Each id goes to its smallest neighbour, and on to that one's, until it is at one that has none; then links are those
    between where their ends are, once each. So a round reads what the one before left, which soon is little.
    """
    spark = links.sparkSession
    between, jumps, labels = Rounds(spark, "cc-links"), Rounds(spark, "cc-jumps"), Rounds(spark, "cc-labels")
    apart = lambda rows: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, out = between.store(apart(links)), None
    while out is None or not left.isEmpty():
        ends = left.select(F.col("a").alias("id"), F.col("a").alias("up")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("up")))
        after = jumps.store(ends.groupBy("id").agg(F.min("up").alias("up"), F.lit(True).alias("moved")))
        while not after.where("moved").isEmpty():
            here = after.select("id", "up")
            above = here.select(F.col("id").alias("up"), F.col("up").alias("beyond"))
            after = jumps.store(here.join(above, "up").select("id", F.col("beyond").alias("up"), (F.col("beyond") != F.col("up")).alias("moved")))
        tops = after.select("id", F.col("up").alias("comp"))
        out = labels.store(tops if out is None else _composed(out, tops))
        at = lambda end: tops.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp"))
        left = between.store(apart(left.join(at("a"), "a").join(at("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))))
    return out


def _composed(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (id, comp) whose components ``more`` (id, comp) labels anew, and the ids of ``more`` that had none."""
    moved = labels.join(more.select(F.col("id").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
    return moved.unionByName(more.join(labels.select("id"), "id", "left_anti").select("id", "comp"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels of ``components`` after more links: only those between different components count, once for each two of them."""
    if labels is None:
        return components(links)
    at = lambda end: labels.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp"))
    moved = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    return stored(_composed(labels, components(moved)), "cc-labels")


def _fixed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row of bytes for each value of a binary column whose values have one length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _least_match(n_values: int, threshold: int) -> float:
    """The share of equal sketch bytes below which a pair is not confirmed."""
    j = threshold / 100
    return (j - MARGIN * (j * (1 - j) / n_values) ** 0.5) * (255 / 256) + 1 / 256


def promising(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Those of (a, b) whose sketches and set sizes let them reach the threshold."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                s, t = _fixed(batch.column("s_a")), _fixed(batch.column("s_b"))
                yield batch.select(["a", "b"]).filter(pa.array((s == t).mean(axis=1) >= _least_match(s.shape[1], threshold)))

    return near.select("a", "b", "s_a", "s_b").mapInArrow(kept, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of (a, b) whose whole sets reach the threshold."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"w_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("w_a", "w_b")).cast("long"))
    return both.where(100 * F.col("common") >= threshold * (F.size("w_a") + F.size("w_b") - F.col("common"))).select("a", "b")


def remaining_pairs(rows: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different components among the members (key, cid, comp) of each bucket that hardly miss a link.

    Sketches leave promising pairs, and for those the upper halves of all shingle hashes bound the intersection from
    above. What passes is a link but for rare chance, so few pairs leave a task however large the bucket is.

    A bucket's largest component is not compared with itself. Its members and the others are dealt into blocks of
    ``block`` rows about, and each pair of blocks is one group of rows, however large the bucket is.
    """
    per_comp = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    per_key = per_key.select(
        "key",
        F.col("most.comp").alias("main"),
        F.ceil(F.col("most.n") / block).cast("int").alias("g_main"),
        F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("g_rest"),
    )
    dealt = rows.join(per_key, "key").join(classes.select("cid", "n", "sketch"), "cid").join(sets.select("cid", "brief"), "cid")
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("comp") == F.col("main"), F.col("g_main")).otherwise(F.col("g_rest"))).cast("int")
    dealt = dealt.withColumn("own", own)
    rest = F.sequence(F.lit(0), F.col("g_rest") - 1)
    # Blocks of the rest are numbered from 0, those of the largest component from -1 downwards.
    with_rest = F.transform(rest, lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    with_main = F.transform(F.sequence(F.lit(1), F.col("g_main")), lambda k: F.struct((-k).alias("i"), F.col("own").alias("j")))
    from_main = F.transform(rest, lambda j: F.struct((-F.col("own") - 1).alias("i"), j.alias("j")))
    groups = F.when(F.col("comp") == F.col("main"), from_main).otherwise(F.concat(with_rest, with_main))
    numbered = F.when(F.col("comp") == F.col("main"), -F.col("own") - 1).otherwise(F.col("own"))
    grouped = dealt.withColumn("g", F.explode(groups)).select("key", "g.i", "g.j", numbered.alias("own"), "cid", "comp", "n", "sketch", "brief")

    def compared(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, own = group.column("i")[0].as_py(), group.column("own").to_numpy()
        cid, comp, n = (group.column(c).to_numpy() for c in ("cid", "comp", "n"))
        sketch = _fixed(group.column("sketch"))
        brief = [np.frombuffer(b, "<u4") for b in group.column("brief").to_pylist()]
        least = _least_match(sketch.shape[1], threshold) * sketch.shape[1]
        same = group.column("j")[0].as_py() == i
        right = np.arange(len(cid)) if same else np.flatnonzero(own != i)
        for x in range(len(cid)) if same else np.flatnonzero(own == i):
            y = right[right > x] if same else right
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]))]
            y = y[(sketch[y] == sketch[x]).sum(axis=1) >= least] if len(y) else y
            if len(y):
                theirs = np.concatenate([brief[k] for k in y])
                mine = brief[x][np.minimum(np.searchsorted(brief[x], theirs), len(brief[x]) - 1)]
                common = np.add.reduceat(mine == theirs, np.cumsum([0, *n[y[:-1]]]), dtype=np.int64)
                y = y[100 * common >= threshold * (n[x] + n[y] - common)]
            if len(y):
                yield np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("key", "i", "j")):
            for a, b in compared(group):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    together = grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return together.mapInArrow(pairs, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches; a group may go over several."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            part = batch.slice(start, stop - start)
            if held and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in by):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    n_words: int = N_WORDS,
    n_permutations: int = PERMUTATIONS,
    band_rows: int = BAND_ROWS,
    star_rounds: int = STAR_ROUNDS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: (doc_id, text_key, n_shingles, component_id, digest, kept)."""
    sketches = stored(sketched(docs, n_words, n_permutations, band_rows), "sketches")
    one = sketches.where("digest IS NOT NULL").groupBy("digest")
    classes = one.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    banded = classes.select("cid", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = stored(banded.join(shared, "key"), "members")

    involved = classes.join(members.select("cid").distinct(), "cid", "left_semi")

    def whole(got: Iterator[tuple]) -> Iterator[tuple]:
        for text, digest, cid in got:
            s = shingles(text, n_words)
            if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                yield cid, s.view(np.int64), (s >> np.uint64(32)).astype("<u4").tobytes()

    wanted = involved.select(F.col("rep").alias("wanted"), "digest", "cid")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text", "digest", "cid")
    sets = stored(map_rows(texts, whole, "cid long, shingles array<long>, brief binary", batch_rows=500).dropDuplicates(["cid"]), "sets")
    classes = classes.select("cid", "rep", "digest", "n", "sketch")

    def with_comps(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("cid"))
        return members.join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))

    labels, turn, fruitful = None, 0, FRUITFUL * involved.count() + 1
    while turn < star_rounds or (turn and fresh >= fruitful):
        rows = with_comps(labels)
        first = F.min_by(F.struct(F.col("cid").alias("p"), F.col("comp").alias("p_comp")), F.struct(F.xxhash64("cid", F.lit(turn)), "cid")).alias("first")
        pivots = rows.groupBy("key").agg(first, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "first.*")
        pairs = rows.join(pivots, "key").where("comp <> p_comp").select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b")).distinct()
        found = stored(confirmed(promising(pairs, classes, threshold), sets, threshold), "links")
        labels, turn, fresh = merged(labels, found), turn + 1, found.count()
    rest = stored(remaining_pairs(with_comps(labels), classes, sets, threshold, block), "pairs")
    labels = merged(labels, stored(confirmed(rest, sets, threshold), "links"))

    comps = labels.withColumnRenamed("id", "cid")
    named = classes.join(comps, "cid", "left").select("digest", "rep", F.coalesce("comp", "cid").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_digest = named.join(smallest, "comp").select("digest", "component_id")
    out = sketches.select("doc_id", "text_key", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), "digest").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """Whole rows of ``docs``, one document of each component: that with the smallest id.

    Rows that repeat an id within a component count as one document, as do rows without ids that have one text.
    """
    kept = near_duplicates(docs, **options).where("kept")
    chosen = kept.groupBy("doc_id", F.when(F.col("component_id").isNull(), F.col("text_key")).alias("of")).agg(F.min("text_key").alias("key")).select("doc_id", "key")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"), F.struct("*").alias("doc"))
    chosen = chosen.withColumnsRenamed({"doc_id": "c_id", "key": "c_key"})
    one = rows.join(chosen, (F.col("key") == F.col("c_key")) & F.col("id").eqNullSafe(F.col("c_id")), "left_semi").dropDuplicates(["id", "key"])
    return one.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: By all pairs that share a shingle: for small tables.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_in JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
near AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""
