"""FASTQ pairs as a Python data source: one partition a pair of files, streamed in Arrow batches.

Gzip files can't be split, and records span four lines, so a pair of files is the unit of work; many lanes run side by
side. Paths are local ones that the executors see, or have a scheme that Arrow's file systems open (``hdfs://``, ``s3://``,
``gs://``, ``file://``).
"""

from __future__ import annotations

import fnmatch
import glob
import gzip
import io
import os
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_id long, title1 string, r1 string, q1 string, title2 string, r2 string, q2 string"
BATCH = 20_000
PER_FILE = 40  # a file's ordinals start at its number shifted by this many bits


def _file_system(path: str):
    """(file system, path in it) of a path with a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    if "://" not in path:
        return os.path.exists(path)
    system, inner = _file_system(path)
    return system.get_file_info(inner).type.name != "NotFound"


def matching(pattern: str) -> list[str]:
    """Files whose path fits a pattern, in any file system; a scheme's patterns are for names within one folder."""
    if "://" not in pattern:
        return glob.glob(pattern)
    from pyarrow import fs

    folder, _, name = pattern.rpartition("/")
    system, inner = _file_system(folder)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [f"{folder}/{f.base_name}" for f in found if f.is_file and fnmatch.fnmatch(f.base_name, name)]


def pair_up(ones: list[str], twos: list[str]) -> list[tuple[str, str]]:
    """Listed R1 and R2 files, zipped in order."""
    if len(ones) != len(twos):
        raise ValueError(f"{len(ones)} R1 files but {len(twos)} R2 files")
    if lost := [f for f in (*ones, *twos) if not exists(f)]:
        raise FileNotFoundError(f"no such files: {lost}")
    return list(zip(ones, twos))


def discover(pattern_or_prefix: str) -> list[tuple[str, str]]:
    """Pairs of R1 and R2 files: of a prefix, a pattern, or one R1 file; an error where a mate is missing."""
    name = pattern_or_prefix
    one_file = name.endswith((".fastq", ".fq", ".fastq.gz", ".fq.gz")) and exists(name)
    found = [name] if one_file else matching(name) if any(c in name for c in "*?[") else matching(f"{name}*_R1*")
    ones = sorted(f for f in found if "_R1" in os.path.basename(f) and f.endswith((".fastq", ".fq", ".fastq.gz", ".fq.gz")))
    if not ones:
        raise FileNotFoundError(f"no R1 files for {pattern_or_prefix}")
    pairs = []
    for one in ones:
        two = os.path.join(os.path.dirname(one), os.path.basename(one).replace("_R1", "_R2", 1))
        if not exists(two):
            raise FileNotFoundError(f"no mate for {one}")
        pairs.append((one, two))
    return pairs


def _open(path: str):
    if "://" in path:
        system, inner = _file_system(path)
        return io.TextIOWrapper(system.open_input_stream(inner), encoding="utf-8")  # gzip is told by the suffix
    return gzip.open(path, "rt") if path.endswith(".gz") else open(path)


def records(path: str):
    """(title, sequence, quality) of each record; one that breaks off is an error."""
    with _open(path) as f:
        while four := [x.rstrip("\r\n") for x in islice(f, 4)]:
            if len(four) < 4:
                if any(four):
                    raise ValueError(f"{path}: the last record breaks off after {len(four)} lines")
                return
            if not four[0].startswith("@"):
                raise ValueError(f"{path}: not a FASTQ record: {four[0][:40]!r}")
            yield four[0][1:], four[1], four[3]


class Pair(InputPartition):
    def __init__(self, number: int, one: str, two: str):
        super().__init__(number)
        self.number, self.one, self.two = number, one, two


class FastqReader(DataSourceReader):
    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs

    def partitions(self):
        return [Pair(i, *p) for i, p in enumerate(self.pairs)]

    def read(self, partition):
        first, rows = partition.number << PER_FILE, zip(records(partition.one), records(partition.two))
        names, n = [f.split()[0] for f in SCHEMA.split(", ")], 0
        while block := list(islice(rows, BATCH)):
            a, b = zip(*block)
            ids = pa.array(range(first + n, first + n + len(block)), pa.int64())
            n += len(block)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in (*zip(*a), *zip(*b))]], names=names)


class FastqSource(DataSource):
    """``spark.read.format("fastq_pairs").load(prefix)``; pairs are zipped by position to the shorter file."""

    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        if "r1" in self.options:
            return FastqReader(pair_up(self.options["r1"].split(","), self.options["r2"].split(",")))
        return FastqReader(discover(self.options["path"]))


def read_fastqs(spark: SparkSession, path: str | None = None, r1: list[str] | None = None, r2: list[str] | None = None) -> DataFrame:
    """Read pairs of a prefix or pattern, or of listed files."""
    spark.dataSource.register(FastqSource)
    reader = spark.read.format("fastq_pairs")
    if r1 or r2:
        return reader.option("r1", ",".join(r1 or [])).option("r2", ",".join(r2 or [])).load()
    return reader.load(path)
