"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a stored table's files that a join may still broadcast: compressed files tell little of how large their rows are.
BROADCAST_BYTES = 64 << 10

_own_folder: tempfile.TemporaryDirectory | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where it is unset in local mode (tests), an own temporary folder."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="cairnlake-")
        atexit.register(_own_folder.cleanup)
    return f"file://{_own_folder.name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's file systems close."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor then costs nothing that came before.

    Joins take Spark's word for a table's size, which is that of its files: ids and repeated texts are a hundred times
    larger as rows. So only tables of few bytes may be broadcast.
    """
    return _by_size(stored_at(df, path := scratch_path(df.sparkSession, name)), path)


def _by_size(df: DataFrame, path: str) -> DataFrame:
    hadoop_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = hadoop_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()
    return shuffled(df) if held > BROADCAST_BYTES else df


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that grows with the input: they sort and merge, and split what is skewed, instead of sending it through the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str, per_task: int = 5_000) -> DataFrame:
    """``df`` in tasks of about ``per_task`` rows, for work on each row that the bytes of a small table tell nothing of."""
    return df.repartition(1 + df.count() // per_task, key)


class Rounds:
    """Tables that replace each other round by round: when one is stored, the one before the last goes."""

    by_size = True

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def store(self, df: DataFrame) -> DataFrame:
        self.paths.append(scratch_path(self.spark, self.name))
        out = stored_at(df, self.paths[-1])
        out = _by_size(out, self.paths[-1]) if self.by_size else out
        if len(self.paths) > 2:
            removed(self.spark, self.paths.pop(0))
        return out


def removed(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
