"""Paged services as a Spark data source, and snapshots of what they said.

``spark.read.format("paged")`` asks a service for its pages in tasks: by offset in runs of pages, each run a partition, or
by the token that each answer gives for the next, each chain a partition. A 429 or 5xx is asked again after the wait that
the service tells; a task that is lost asks for its own pages again. Tasks share one rate without talking to each other:
the k-th request of partition p of n has a slot of its own, ``(k * n + p) / rate`` after the start.

``spark.write.format("snapshots")`` keeps records in a folder that pyarrow's file systems reach. Each task writes a file
and tells its name, rows and digest to the driver, which writes them as the manifest of the run when all tasks are done;
``spark.read.format("snapshots")`` reads what manifests name and nothing else, and checks the digests.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cairnlake.operators import stats
from cairnlake.sources.scratch import stored

#: Answers that are asked for again.
ASK_AGAIN = (429, 500, 502, 503, 504)
#: ``nth`` of the row that ends a partition; its ``more`` tells whether a bound stopped it with pages left.
END = -1
PAGES = "chain int, page int, nth int, record string, more boolean"
RECORDS = "chain int, page int, nth int, record string"


def _named(path: str) -> Callable:
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Run(InputPartition):
    """Pages ``first`` to ``last`` of a chain, one after another."""

    nth: int
    chain: int
    first: int
    last: int
    #: Whether it is the last run that the bound on pages allows.
    bounded: bool

    def __init__(self, nth: int, chain: int, first: int, last: int, bounded: bool):
        super().__init__(nth)
        self.nth, self.chain, self.first, self.last, self.bounded = nth, chain, first, last, bounded


class PagedService(DataSource):
    """Options: ``fetch`` (module:function of a request, giving status, answer and seconds to wait), ``mode`` (offset or token),
    ``chains`` (JSON list of what all requests of a chain ask for), ``page_size``, ``max_pages``, ``run`` (pages of a partition), ``tries``, ``rate_per_hour``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.fetch, self.token = low["fetch"], low.get("mode", "offset") == "token"
        self.chains = json.loads(low.get("chains", "[{}]"))
        self.page_size, self.max_pages = int(low.get("page_size", 100)), int(low.get("max_pages", 10))
        self.run, self.tries = int(low.get("run", 10)), int(low.get("tries", 4))
        self.rate, self.started = float(low.get("rate_per_hour", 0)), time.time()
        self.n = len(self.partitions())

    def partitions(self) -> list[Run]:
        step = self.max_pages if self.token else self.run
        spans = [(c, a, min(a + step, self.max_pages)) for c in range(len(self.chains)) for a in range(0, self.max_pages, step)]
        return [Run(i, c, a, b, b == self.max_pages) for i, (c, a, b) in enumerate(spans)]

    def _asked(self, function: Callable, request: dict, part: Run, k: int) -> tuple[dict, int]:
        """The answer, and how many requests there have been."""
        for _ in range(self.tries):
            if self.rate:
                slot = self.started + (k * self.n + part.nth) * 3600 / self.rate
                time.sleep(max(0.0, slot - time.time()))
            status, answer, wait = function(request)
            k += 1
            if status == 200:
                return answer, k
            if status not in ASK_AGAIN:
                raise RuntimeError(f"the service answered {status} to {request}")
            time.sleep(wait)
        raise RuntimeError(f"the service answered {status} {self.tries} times to {request}")

    def read(self, part: Run) -> Iterator[tuple]:
        function, token, k = _named(self.fetch), None, 0
        for page in range(part.first, part.last):
            place = {"token": token} if self.token else {"offset": page * self.page_size}
            answer, k = self._asked(function, {**self.chains[part.chain], **place, "limit": self.page_size}, part, k)
            for nth, row in enumerate(answer["records"]):
                yield part.chain, page, nth, json.dumps(row, sort_keys=True, ensure_ascii=False), None
            token = answer.get("next")
            if (not token) if self.token else len(answer["records"]) < self.page_size:
                break
        else:
            yield part.chain, part.last - 1, END, None, part.bounded
            return
        yield part.chain, page, END, None, False


@dataclass
class Pages:
    """``records`` (chain, page, nth, record) without repeats and within the bound; ``report`` has one row of counts."""

    records: DataFrame
    report: DataFrame


def read_pages(spark: SparkSession, key: str, max_records: int | None = None, **options: object) -> Pages:
    """All pages of a service. Of the records with one ``key`` the first stays; more than ``max_records`` are cut off in page order."""
    spark.dataSource.register(PagedService)
    reader = spark.read.format("paged")
    for name, value in options.items():
        reader = reader.option(name, value if isinstance(value, str) else json.dumps(value))
    got = stored(reader.load(), "pages")
    rows = got.where(F.col("nth") != END)
    place = F.struct("chain", "page", "nth")
    of_key = F.get_json_object("record", f"$.{key}")
    first = rows.groupBy(of_key.alias("key")).agg(F.min_by(F.struct("chain", "page", "nth", "record"), place).alias("r")).select("r.*")
    kept = first
    if max_records is not None:
        kept = stats.numbered(first.withColumnRenamed("nth", "at"), ["chain", "page", "at"], "place").where(F.col("place") <= max_records).select("chain", "page", F.col("at").alias("nth"), "record")
    kept = stored(kept, "records")
    told = got.agg(F.count_if(F.col("nth") != END).alias("read"), F.countDistinct(F.when(F.col("nth") != END, F.struct("chain", "page"))).alias("pages"), F.max(F.coalesce("more", F.lit(False))).alias("more"))
    counts = first.agg(F.count(F.lit(1)).alias("distinct"))
    given = kept.agg(F.count(F.lit(1)).alias("records"))
    report = told.join(F.broadcast(counts), how="cross").join(F.broadcast(given), how="cross")  # a row each
    cut = F.col("distinct") > F.col("records")
    return Pages(kept, report.select("pages", "read", (F.col("read") - F.col("distinct")).alias("repeats"), "records", (F.coalesce("more", F.lit(False)) | cut).alias("truncated")))


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    digest: str


class Snapshots(DataSource):
    """Option ``folder``; ``run`` names what is written and, of what is read, the one run that is wanted."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return RECORDS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SnapshotWriter(self.options["folder"], self.options.get("run") or uuid.uuid4().hex)

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options["folder"], self.options.get("run"))


class _SnapshotWriter(DataSourceWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, run

    def write(self, rows: Iterator) -> Written:
        # A task that is tried again writes a file of another name; only the one that is told counts.
        name, digest, n = f"{self.run}-{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0
        system, path = _file_system(self.folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            for chain, page, nth, record in rows:
                line = json.dumps([chain, page, nth, record], ensure_ascii=False).encode() + b"\n"
                out.write(line)
                digest.update(line)
                n += 1
        return Written(name, n, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _file_system(self.folder)
        files = [{"name": m.name, "rows": m.rows, "sha256": m.digest} for m in messages if m is not None]
        with system.open_output_stream(f"{path}/{self.run}.manifest.new") as out:
            out.write(json.dumps({"run": self.run, "rows": sum(f["rows"] for f in files), "files": files}, indent=1).encode())
        system.move(f"{path}/{self.run}.manifest.new", f"{path}/{self.run}.manifest")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _file_system(self.folder)
        for m in messages:
            if m is not None:
                system.delete_file(f"{path}/{m.name}")


@dataclass
class _File(InputPartition):
    name: str
    digest: str

    def __init__(self, name: str, digest: str):
        super().__init__(name)
        self.name, self.digest = name, digest


class _SnapshotReader(DataSourceReader):
    def __init__(self, folder: str, run: str | None):
        self.folder, self.run = folder, run

    def partitions(self) -> list[_File]:
        return [_File(f["name"], f["sha256"]) for m in manifests(self.folder) if self.run in (None, m["run"]) for f in m["files"]] or [_File("", "")]

    def read(self, part: _File) -> Iterator[tuple]:
        if not part.name:
            return
        system, path = _file_system(self.folder)
        digest = hashlib.sha256()
        with system.open_input_stream(f"{path}/{part.name}") as said:
            rest = b""
            while block := said.read(1 << 20):
                digest.update(block)
                *lines, rest = (rest + block).split(b"\n")
                yield from (tuple(json.loads(line)) for line in lines)
        if digest.hexdigest() != part.digest:
            raise ValueError(f"{part.name} is not what its manifest says")


def manifests(folder: str) -> list[dict]:
    """The manifests of a folder's finished runs."""
    system, path = _file_system(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [json.loads(system.open_input_stream(f.path).read()) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".manifest")]


def write_snapshot(records: DataFrame, folder: str, run: str) -> None:
    records.sparkSession.dataSource.register(Snapshots)
    records.select("chain", "page", "nth", "record").write.format("snapshots").option("folder", folder).option("run", run).mode("append").save()


def read_snapshot(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    spark.dataSource.register(Snapshots)
    reader = spark.read.format("snapshots").option("folder", folder)
    return (reader.option("run", run) if run else reader).load()


def kept_pages(request: dict) -> tuple[int, dict, float]:
    """A service that answers from pages kept in ``folder`` as ``page=N`` folders of JSON lines; past the last it has none."""
    system, path = _file_system(request["folder"])
    page = int(request["token"] or 0) if "token" in request else request["offset"] // request["limit"]
    found = system.get_file_info(fs.FileSelector(f"{path}/page={page}", allow_not_found=True))
    lines = [line for f in sorted(found, key=lambda f: f.path) if f.path.rsplit("/", 1)[1].startswith("part-") for line in system.open_input_stream(f.path).read().splitlines()]
    more = system.get_file_info(f"{path}/page={page + 1}").type == fs.FileType.Directory
    return 200, {"records": [json.loads(line) for line in lines], "next": str(page + 1) if more else None}, 0.0
