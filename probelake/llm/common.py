"""Shared helpers: reading tables, word splitting, cutting lineage in the shared folder, sizes that allow a broadcast."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

#: What separates words: space and the ASCII controls 9 to 13, as a Java character class.
SPACES = r"[ \t-\r]+"
#: Bytes that an Arrow batch of a Python stage holds, unless one row is larger.
BATCH_BYTES = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_cuts: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Python stages get batches of at most ``BATCH_BYTES``, so that long texts don't meet by the thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def words(text: Column) -> Column:
    """Maximal runs of anything but space and ``\\x09-\\x0D``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only in local mode, where all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="probelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = path_of(spark, path)
    fs.delete(jpath, True)


def write(df: DataFrame, path: str) -> None:
    """``df`` at ``path``; the shuffle files that it took go as soon as it is written, as nothing can need them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/probelake/{uuid.uuid4().hex}"
    write(df, path)
    fs, jpath = path_of(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    _cuts[out] = path
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; neither they nor anything derived from them may be read again."""
    for df in cuts:
        if path := _cuts.pop(df, None):
            remove(df.sparkSession, path)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Within, ``cut`` adds the paths that it writes to ``paths``."""
    before, _made.paths = getattr(_made, "paths", None), paths
    try:
        yield
    finally:
        _made.paths = before


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def bytes_in_memory(df: DataFrame) -> int:
    """What the rows of a table of ``cut`` take as a hash relation, at most about: its count of rows comes from file footers."""
    n = df.count()
    fixed = 48 + 16 * len(df.columns)
    if not any(isinstance(f.dataType, (ArrayType, BinaryType, MapType, StringType)) for f in df.schema):
        return n * fixed
    size = lambda f: F.octet_length(f.name) if isinstance(f.dataType, (BinaryType, StringType)) else 32 * F.size(f.name)
    wide = [F.coalesce(size(f), F.lit(0)) for f in df.schema if isinstance(f.dataType, (ArrayType, BinaryType, MapType, StringType))]
    return n * fixed + (df.agg(F.sum(sum(wide, F.lit(0)).cast("long"))).first()[0] or 0)


def maybe_broadcast(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a table of ``cut`` only where its rows take less than a checked size; beyond it Spark joins by shuffle."""
    if df not in _cuts:
        df = cut(df)
    return F.broadcast(df) if bytes_in_memory(df) <= limit_bytes else df
