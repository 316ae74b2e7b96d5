"""Tables written in the shared folder between the steps of an operator.

A written table cuts the lineage, survives the loss of executors, has no partitioning of its own (so that adaptive execution
may split both sides of a join on it) and lets the shuffle files of finished steps go.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where the setting is unset, as in local tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_open: list[list[Workspace]] = []


@contextmanager
def workspaces() -> Iterator[list[Workspace]]:
    """The workspaces that are made within the block, so that their tables can go once the result is written."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        _open.pop()


class Workspace:
    """A folder of written tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        if _open:
            _open[-1].append(self)

    def write(self, df: DataFrame, name: str, free: bool = True) -> DataFrame:
        """Writes ``df`` and reads it again with the schema it had."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        self.paths.setdefault(name, []).append(path)
        schema = df.schema
        df.write.parquet(path)
        del df
        if free:
            free_shuffles(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def remove(self, *names: str) -> None:
        """Deletes the tables written under these names (none: all); what was made of them must have been written itself."""
        names = names or tuple(self.paths)
        context = self.spark.sparkContext
        for path in (p for n in names for p in self.paths.pop(n, [])):
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: Seconds between two collections of the driver's garbage at least.
PAUSE = 3.0
_last = {"at": 0.0}


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished queries: it acts when the driver's JVM collects garbage. Steps that
    follow each other fast are left to the next call."""
    if time.monotonic() - _last["at"] < PAUSE:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _last["at"] = time.monotonic()


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that other columns can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])
