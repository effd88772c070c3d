"""Stages that are run once: each is kept under a digest of its name, its parameters and what it reads.

A stage reads tables, by path, and other stages. Its key is a digest of its parameters, of the files of its tables (names,
sizes and times) and of the keys of its stages; what it returns is written under the key. A run that finds a whole
result takes it, so a run after a failure begins where that one ended, and a change of one table or parameter makes anew
only what depends on it. Each run keeps a profile of its stages.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "run string, nth int, stage string, status string, key string, seconds double, rows long, notes string"


@dataclass
class Stage:
    key: str
    result: DataFrame


@dataclass
class Stages:
    spark: SparkSession
    folder: str
    run: str
    profile: list[tuple] = field(default_factory=list)

    def _fs(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """Names, sizes and times of a table's files."""
        at, fs = self._fs(path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        found, out = fs.listFiles(at, True), []
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def stage(self, name: str, make: Callable[..., DataFrame], tables: Sequence[str] = (), after: Sequence[Stage] = (), params: Mapping[str, object] | None = None) -> Stage:
        """The result of ``make`` of the tables' frames and the stages' results, with ``params`` by name; made if it isn't there."""
        said = json.dumps([name, sorted((params or {}).items()), [self.files(t) for t in tables], [s.key for s in after]], default=str)
        key = hashlib.sha256(said.encode()).hexdigest()[:16]
        path, began = f"{self.folder}/{name}-{key}", time.time()
        done, fs = self._fs(f"{path}/_SUCCESS")
        status = "REUSED" if fs.exists(done) else "PASS"
        try:
            if status == "PASS":
                frames = [self.spark.read.parquet(t) for t in tables] + [s.result for s in after]
                make(*frames, **(params or {})).write.mode("overwrite").parquet(path)
            result = self.spark.read.parquet(path)
            rows = result.count()
        except Exception as error:
            self._note(name, "FAIL", key, began, 0, f"{type(error).__name__}: {str(error)[:200]}")
            raise
        self._note(name, status, key, began, rows, "")
        return Stage(key, result)

    def _note(self, name: str, status: str, key: str, began: float, rows: int, notes: str) -> None:
        self.profile.append((self.run, len(self.profile), name, status, key, round(time.time() - began, 2), rows, notes))
        frame = self.spark.createDataFrame(self.profile, PROFILE)
        frame.coalesce(1).write.mode("overwrite").json(f"{self.folder}/profile/run={self.run}")

    @staticmethod
    def profiles(spark: SparkSession, folder: str) -> DataFrame:
        """The stages of all runs in a folder."""
        return spark.read.schema(PROFILE).option("basePath", f"{folder}/profile").json(f"{folder}/profile/run=*")


def resume_state(profiles: DataFrame) -> DataFrame:
    """(run, completed, failed): the stages of each run, in order."""
    of = lambda *wanted: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status").isin(*wanted), F.struct("nth", "stage")))), lambda x: x["stage"]), "|")
    return profiles.groupBy("run").agg(of("PASS", "REUSED").alias("completed"), of("FAIL").alias("failed"))
