"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from visitledger.sources.files import delete

SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = Lock()
_writers = 0
_owners: list[list[str]] = []


def staging_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    `spark.checkpoint.dir`, or the directory given to `setCheckpointDir`. Where
    neither is set, a folder inside the warehouse, unless the executors are on
    other machines and the warehouse is on this one's disk: that is an error.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_staged"
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors reach; {folder} is local")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def owned_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of `temporary_tables`."""
    path = f"{staging_folder(spark)}/{name}-{uuid4().hex}"
    with _lock:
        for paths in _owners:
            paths.append(path)
    return path


@contextmanager
def _shuffles_removed_after_write(spark: SparkSession) -> Iterator[None]:
    """While a staged table is written, its shuffle files go as soon as it is done."""
    global _writers
    with _lock:
        if _writers == 0:
            _shuffles_removed_after_write.before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if _writers == 0:
                spark.conf.set(_CLEANUP, _shuffles_removed_after_write.before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Used where several branches need one result: it is computed once, survives
    the loss of executors, and each branch reads only its own columns. The
    caller's result may be read at any later time, so the files stay until the
    end of `temporary_tables` or until the folder is cleaned, like checkpoints.
    """
    spark = df.sparkSession
    path = owned_path(spark, name)
    with _shuffles_removed_after_write(spark):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def stage_all(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """Stage frames that do not depend on each other at the same time.

    The jobs share the cluster, so small tables are written in the gaps the
    last tasks of a large one leave. The threads inherit the caller's job group
    and scheduler pool.
    """
    found: dict[str, DataFrame] = {}
    failed: list[BaseException] = []

    def work(name: str) -> None:
        try:
            found[name] = stage(frames[name], name)
        except BaseException as problem:  # raised again below, in the caller's thread
            failed.append(problem)

    threads = [InheritableThread(target=work, args=(name,)) for name in frames]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failed:
        raise failed[0]
    return [found[name] for name in frames]


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside when the block ends.

    Write the result within the block; afterwards its inputs are gone.
    """
    paths: list[str] = []
    with _lock:
        _owners.append(paths)
    try:
        yield
    finally:
        with _lock:
            _owners[:] = [x for x in _owners if x is not paths]
        for path in paths:
            delete(spark, path)


def drop_staged(df: DataFrame) -> None:
    """Delete a table that `stage` returned, once what was made from it is staged itself."""
    delete(df.sparkSession, df._staged_at)
