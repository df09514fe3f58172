"""Shared folders, lineage cuts and size checks. Works the same on a laptop and on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir() + "/docflow"


_made: ContextVar[list[str] | None] = ContextVar("scratch_paths", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediates written inside are deleted at the end; write the results you keep before it.

    Plans over person records keep real names in their intermediates: run them inside a scope.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never forces the whole loop to run again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession) + "/checkpoints")
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for what runs inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: For what is written and read again from there: its shuffle files go with the job instead of some time later.
CLEAN = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    For results used by several branches: later branches read only the columns they need, and a lost
    executor costs the re-read of a few files, not the work before them. ``batch_rows`` is for plans whose rows
    are large: how many of them Python gets at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    batches = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(batch_rows)} if batch_rows else {}
    with settings(spark, **CLEAN, **batches):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete intermediates that ``materialize`` has returned and nothing will read any more."""
    for df in frames:
        if path := _written.pop(df, None):
            _delete(df.sparkSession, path)


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that has rows for every document: it is shuffled, never broadcast.

    Spark takes a table for as small as its compressed files. Pseudonyms, patterns and copied texts are many times
    larger in memory, so a broadcast that Spark chose by itself filled the driver.
    """
    return df.hint("merge")


def explode_rows(df: DataFrame, keep: list, array: Column | str, pos: str, item: str) -> DataFrame:
    """``keep`` columns plus position and item of a computed array.

    The outer form stops Spark from repeating the whole array expression inside an inferred
    ``size(array) > 0`` filter.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.where(F.col(pos).isNotNull())


def fill_cores(scan: DataFrame) -> DataFrame:
    """Spread a plain scan that has fewer splits than the cluster has cores.

    Only small inputs are that few splits, so this never shuffles a large table.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
