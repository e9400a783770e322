"""Intermediate tables in the folder that all executors share.

A materialized table cuts lineage: it survives the loss of executors and is read
as often as needed without computing its plan again. The folder is the one the
session names in ``spark.checkpoint.dir``. Only where that is unset *and* the
master is local is a temporary folder made; a cluster without the setting is an
error, since a folder of one machine would not be seen by the others.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; it is deleted when the session's JVM ends."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexiquarry-")
        spark.conf.set(_KEY, root)
    own = f"{root.rstrip('/')}/lexiquarry-{spark.sparkContext.applicationId}"
    path, fs = _fs(spark, own)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def _fs(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_open: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are materialized inside when it ends: for work whose results have been written or collected by then.

    Tables made outside of any scope stay until the session's JVM ends.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop(spark, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the same rows, all columns nullable. options: the writer's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _open:
        _open[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def initial_partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """Let shuffles of the jobs run inside start with at least so many partitions, before adaptive execution joins small ones."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    usual = int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, key, str(max(usual, least))):
        yield


@contextmanager
def hashed_joins(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Let adaptive execution join by hash tables instead of sorting where every partition of a side is measured to be at most so large."""
    with setting(spark, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(most_bytes)):
        yield


def drop(spark: SparkSession, where: str) -> None:
    path, fs = _fs(spark, where)
    fs.delete(path, True)


def names_in(spark: SparkSession, where: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    path, fs = _fs(spark, where)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def write_new(spark: SparkSession, where: str, text: str) -> None:
    """Write a small file that must not exist yet: whole beside its place, then renamed."""
    path, fs = _fs(spark, where)
    side, _ = _fs(spark, f"{where}.{uuid.uuid4().hex[:8]}")
    out = fs.create(side, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(path) or not fs.rename(side, path):
        fs.delete(side, False)
        raise FileExistsError(where)


def read_text(spark: SparkSession, where: str) -> str | None:
    path, fs = _fs(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    return text


def size_of(df: DataFrame) -> int | None:
    """Bytes of a table as the optimizer estimates them from its files; None if it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def fits_broadcast(df: DataFrame, limit_bytes: int) -> bool:
    """Whether a *materialized* table is proven small: rows times the width of its schema, strings by their real length."""
    from pyspark.sql import functions as F

    strings = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    row = df.agg(F.count("*").alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(strings)]).first()
    size = row["n"] * (40 + 16 * len(df.columns)) + sum(row[f"s{i}"] for i in range(len(strings)))
    return size <= limit_bytes


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python find this package, wherever they run: its files go to them once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="lexiquarry-code-")) / "lexiquarry.zip"  # only the driver reads it, and serves it
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
