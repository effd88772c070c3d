"""What the operators share: word rules, label reading and row mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cairnlake.sources import scratch
from cairnlake.sources.scratch import scratch_path, shared_dir, stored_at

__all__ = ["WORD", "Rounds", "filter_rows", "is_held_out", "map_rows", "one_label", "pieces_of", "released", "scratch_path", "shared_dir", "stored", "table", "worker_cache"]

#: A word is a maximal run of characters other than blank and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that become Python values at a time; a longer text is one piece.
AT_A_TIME = 4 << 20

_kept: dict[str, object] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``scratch.stored``; these tables hold numbers and texts that are about as large as their files, so joins may go by those."""
    return stored_at(df, scratch_path(df.sparkSession, name))


class Rounds(scratch.Rounds):
    by_size = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is a multiple of 5. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): the larger label where a document has several; null ids and labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("y"))
    )


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks under ``name``; another name's is dropped, so one operator's is held."""
    if name not in _kept:
        _kept.clear()
        released()
        _kept[name] = make()
    return _kept[name]


def released() -> None:
    """Gives freed memory back to the system: workers outlive tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces_of(batch: pa.RecordBatch, at_a_time: int = AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of ``at_a_time`` bytes of strings and lists, or of one row."""
    sizes = np.full(len(batch), 64, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif len(c):
            sizes += c.nbytes // len(c)
    upto, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + at_a_time, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_rows(df: DataFrame, rows_of: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str, batch_rows: int = 2000) -> DataFrame:
    """``rows_of`` over a task's rows as plain Python values: nulls are None, 64-bit ids stay exact.

    Rows become values ``AT_A_TIME`` bytes at a time and results leave in batches of ``batch_rows``, so a task holds
    one Arrow batch of input, a piece of it as values and one batch of output.
    """
    arrow = to_arrow_schema(_parse_datatype_string(ddl))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = iter(rows_of(row for batch in batches for piece in pieces_of(batch) for row in zip(*(c.to_pylist() for c in piece.columns), strict=True)))
        while some := list(islice(made, batch_rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)
        released()

    return df.mapInArrow(mapped, ddl)


def filter_rows(df: DataFrame, wanted: Callable[[list], Iterable[bool]], column: str, keep: int | None = None) -> DataFrame:
    """Whole rows of ``df`` whose value in ``column`` is wanted; ``keep`` is the number of leading columns that stay."""
    schema = df.select(*[F.col(f"`{c}`") for c in df.columns[:keep]]).schema
    at = df.columns.index(column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                rows = piece.filter(pa.array(wanted(piece.column(at).to_pylist()), pa.bool_()))
                yield rows.select(list(range(keep or rows.num_columns)))
        released()

    return df.mapInArrow(kept, schema)
