"""Lines that many documents share, dropped everywhere: levelled sorted runs of line hashes, in DataFrame operations only.

A run holds (hash, number of documents) of the line keys of one or several batches, dealt into buckets by the hash and
sorted within them, and its settled keys (found in ``min_docs`` documents already) lie apart from the open ones. A new
batch counts its own keys, merge-anti-joins the settled keys of all runs - bucket by bucket, without moving a run - and
adds what is left as a run of its own. As soon as a level has ``FANOUT`` runs they are compacted into one run of the
next level, which adds up the counts and may settle keys; so a key is rewritten once per level, not once per batch. Run
names say which batches are inside: a store that was cut off during a compaction opens with the wider run. When the
last batch is in, keys whose counts add up to ``min_docs`` lose all their lines in every document: lines semi-join the
keys on hashes and positions alone, and the texts are joined once to the positions that they lose.

A line's key is the line without blanks and U+0009..U+000D at its ends and with A-Z lower-cased; its hash is 128 bits
wide. A line that one row repeats counts once for that row.

Defined results: null and empty texts are one empty line; lines with an empty key stay; a document that loses all its
lines has the empty text; each row counts as a document, whatever its id is (null or repeated); an empty table gives no
rows; other columns ride along untouched in ``doc``. A long text is cut, joined and rewritten in time linear in its
length.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored, table

#: Keys of that many code points in that many documents go.
MIN_CHARS, MIN_DOCS = 1, 10
#: Runs of one level that become one of the next.
FANOUT = 4
#: Batches that the files of a table are taken in.
BATCHES = 8
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("hi", "lo")


def hash_of(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("hi"), F.xxhash64(F.lit("lines"), value).alias("lo")]


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; a text of single bytes takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """The hashes of the lines of a text in order, null where a key is shorter than ``min_chars``."""
    keys = F.transform(F.split(lowered(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(keys, lambda key: F.when(F.length(key) >= min_chars, F.struct(*hash_of(key))))


class LineRuns:
    """A store of levelled runs in ``folder`` (one that all executors share), ``buckets`` files to a run."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.min_docs, self.min_chars, self.fanout = spark, folder, min_docs, min_chars, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (first batch, last batch, name of the table), in order.
        self.runs: list[tuple[int, int, str]] = []
        self._opened()

    def add(self, docs: DataFrame) -> None:
        """Counts the lines of a batch of documents: their keys that no run has settled become a run."""
        seen = F.explode(F.array_distinct(line_hashes(F.col("text"), self.min_chars))).alias("line")
        counts = docs.select(seen).where("line IS NOT NULL").groupBy(*[F.col(f"line.{c}").alias(c) for c in HASH]).agg(F.count(F.lit(1)).alias("docs"))
        for _, _, name in self.runs:
            counts = counts.join(self._of(name, settled=True).select(*HASH).hint("merge"), list(HASH), "left_anti")
        nth = self.runs[-1][1] + 1 if self.runs else 0
        self._write(counts, nth, nth)
        while (level := self._full()) is not None:
            self._compact(level)

    def frequent(self) -> DataFrame:
        """(hi, lo) of the keys that ``min_docs`` documents or more hold, over all batches."""
        if not self.runs:
            return self.spark.createDataFrame([], "hi long, lo long")
        settled, still_open = None, None
        for _, _, name in self.runs:
            a, b = self._of(name, settled=True).select(*HASH), self._of(name, settled=False).select(*HASH, "docs")
            settled, still_open = (a, b) if settled is None else (settled.unionByName(a), still_open.unionByName(b))
        late = still_open.groupBy(*HASH).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= self.min_docs)
        return settled.unionByName(late.select(*HASH)).distinct()

    def _full(self) -> list[tuple[int, int, str]] | None:
        """The runs of the lowest level that has ``fanout`` of them."""
        levels: dict[int, list] = {}
        for run in self.runs:
            levels.setdefault(run[1] - run[0] + 1, []).append(run)
        return next((found for _, found in sorted(levels.items()) if len(found) >= self.fanout), None)

    def _compact(self, runs: list[tuple[int, int, str]]) -> None:
        rows = None
        for _, _, name in runs:
            one = self.spark.table(name).select(*HASH, "docs")
            rows = one if rows is None else rows.unionByName(one)
        merged = rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"))
        first, last = runs[0][0], runs[-1][1]
        self.runs = [r for r in self.runs if r not in runs]
        self._write(merged, first, last)
        for a, b, name in runs:
            self.spark.sql(f"DROP TABLE {name}")
            self._fs().delete(self._path(f"{self.folder}/run-{a:08d}-{b:08d}-{self.buckets}"), True)

    def _write(self, counts: DataFrame, first: int, last: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        settled = counts.withColumn("settled", F.col("docs") >= self.min_docs)
        writer = settled.write.partitionBy("settled").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("compression", "zstd")
        writer.option("path", f"{self.folder}/run-{first:08d}-{last:08d}-{self.buckets}").format("parquet").saveAsTable(name)
        self.runs = sorted([*self.runs, (first, last, name)])

    def _of(self, name: str, settled: bool) -> DataFrame:
        return self.spark.table(name).where(F.col("settled") == settled)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _opened(self) -> None:
        """Takes up the finished runs of the folder; one that a wider run holds is left over from a compaction."""
        found = self._fs().globStatus(self._path(f"{self.folder}/run-*/_SUCCESS")) or []
        told = [(int(m[1]), int(m[2]), int(m[3])) for f in found if (m := re.search(r"/run-(\d+)-(\d+)-(\d+)/_SUCCESS$", f.getPath().toString()))]
        if told:
            self.buckets = told[0][2]
        for first, last, buckets in told:
            if any(a <= first and last <= b and (a, b) != (first, last) for a, b, _ in told):
                continue
            name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {name} (hi BIGINT, lo BIGINT, docs BIGINT, settled BOOLEAN) USING parquet PARTITIONED BY (settled) "
                f"CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {buckets} BUCKETS LOCATION '{self.folder}/run-{first:08d}-{last:08d}-{buckets}'"
            )
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            self.runs.append((first, last, name))
        self.runs.sort()

    def close(self) -> None:
        """Takes the runs out of the catalogue; their files stay."""
        for *_, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def without_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, n_lines, n_dropped, kept): ``doc`` is the row of ``docs``, ``kept`` its text without the lines of ``frequent``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_text = [h.alias(f"text_{n}") for h, n in zip(hash_of(text), HASH, strict=True)]
    lines = docs.select(*of_text, F.posexplode(line_hashes(F.col("text"), min_chars)).alias("at", "line")).where("line IS NOT NULL")
    lines = lines.select("text_hi", "text_lo", "at", *[F.col(f"line.{c}").alias(c) for c in HASH])
    gone = lines.join(frequent, list(HASH), "left_semi").groupBy("text_hi", "text_lo").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    gone = stored(gone, "gone-lines")  # a table of its own, so that the join below may split a text that very many rows have
    rows = docs.select(*of_text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = rows.join(gone, ["text_hi", "text_lo"], "left").select("doc", F.coalesce(F.col("gone"), F.lit([]).cast("array<int>")).alias("gone"))
    # Positions become flags that lie beside the lines: how many lines stay before each one that goes.
    n_gone = F.size("gone")
    before = F.concat(F.array(F.lit(-1)), F.slice("gone", F.lit(1), F.greatest(n_gone - 1, F.lit(0))))
    stay = F.transform(F.arrays_zip(F.col("gone").alias("p"), before.alias("b")), lambda z: F.concat(F.array_repeat(F.lit(False), z["p"] - z["b"] - 1), F.array(F.lit(True))))
    flags = F.when(n_gone > 0, F.flatten(stay)).otherwise(F.lit([]).cast("array<boolean>"))
    of_doc = F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n", -1)
    beside = F.filter(F.arrays_zip(of_doc.alias("line"), flags.alias("flag")), lambda z: ~F.coalesce(z["flag"], F.lit(False)))
    kept = F.when(n_gone == 0, F.coalesce(F.col("doc.text"), F.lit(""))).otherwise(F.array_join(F.transform(beside, lambda z: z["line"]), "\n"))
    return joined.select("doc", F.size(of_doc).cast("long").alias("n_lines"), n_gone.cast("long").alias("n_dropped"), kept.alias("kept"))


def batches_of(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """The files of a table in up to ``batches`` groups, as if they had come one after another."""
    files = sorted(docs.inputFiles())
    if not files:
        return [docs]
    per = -(-len(files) // batches)
    return [docs.sparkSession.read.schema(docs.schema).parquet(*files[i : i + per]) for i in range(0, len(files), per)]


def dedup_lines(docs: DataFrame, batches: list[DataFrame] | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``without_lines`` of the lines that ``min_docs`` documents share, counted batch by batch."""
    spark = docs.sparkSession
    runs = LineRuns(spark, scratch_path(spark, "line-runs"), min_docs, min_chars)
    for batch in [docs] if batches is None else batches:
        runs.add(batch)
    frequent = stored(runs.frequent(), "frequent-lines")
    runs.close()
    return without_lines(docs, frequent, min_chars)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, batches_of(docs))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM numbered),
keyed AS (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.r, k.i, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(n.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked m JOIN numbered n ON m.r = n.r GROUP BY m.r
"""
