"""Small files and folders in whatever store Spark writes to."""

from __future__ import annotations

from uuid import uuid4

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    store, place = _store(spark, path)
    store.delete(place, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file."""
    store, place = _store(spark, path)
    out = store.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    """Read a small file."""
    store, place = _store(spark, path)
    stream = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_folder(spark: SparkSession, fresh: str, target: str) -> None:
    """Let the finished folder `fresh` take the place of `target`, which may exist."""
    store, new = _store(spark, fresh)
    _, old = _store(spark, target)
    aside = None
    if store.exists(old):
        aside = f"{target}.old-{uuid4().hex}"
        if not store.rename(old, _store(spark, aside)[1]):
            raise OSError(f"{target} cannot be moved aside")
    if not store.rename(new, old):
        if aside is not None:
            store.rename(_store(spark, aside)[1], old)
        raise OSError(f"{fresh} cannot be moved to {target}")
    if aside is not None:
        delete(spark, aside)
