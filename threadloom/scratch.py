"""Tables in the folder that the driver and all executors share: cuts in a lineage that outlive any executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_results: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Clusters name it in ``spark.checkpoint.dir``. Where that is unset a temporary folder serves on a local master, where
    driver and executor are one process; on any other master that would be each machine's own, so it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="threadloom-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/threadloom/{tag}-{uuid.uuid4().hex}"


def remove_dir(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def result_path(spark: SparkSession, tag: str) -> str:
    """A fresh path whose files stay as long as the driver's process, or until ``clean_up``."""
    path = fresh_path(spark, tag)
    _results.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back. It stays as long as the driver's process, or until ``clean_up``."""
    path = result_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes to the shared folder while it runs; ``with`` removes them, also when it fails.

    What the operator gives back must depend on results alone, which outlive it.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.root, self._tag, self._spark, self._n = fresh_path(spark, f"{tag}-scratch"), tag, spark, 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove_dir(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        return materialise(df, self._tag)


@atexit.register
def clean_up() -> None:
    """Remove the results that operators of this process have written to the shared folder."""
    while _results:
        remove_dir(_results.pop())
