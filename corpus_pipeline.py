"""From raw documents to packed sequences: five stages, each written as Parquet and read back by the next.

Stage by stage: quality rules (rejected documents go), n-gram Jaccard join (of each group of near duplicates the one
with the least id stays), secret scan (spans are replaced by their kind in brackets), source mixing (each document as
often as its source's target asks), packing (a row for each piece of a sequence). All but the last return the columns
of ``documents``; other columns pass through, whatever their names.

Null texts count as empty and so fail the quality rules; empty tables pass through as empty. A document without an id
takes part in deduplication under a key made of its text, which comes after all usual ids, and stays if no document
with an id is like it. Of rows that agree in id and text one stays (ties by the other columns don't matter: the least
of them in Spark's order). Very long texts pass through whole.

What a stage writes besides its result is deleted when the next one begins, as by then that result is written.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelake.llm import common, host_rules, jaccard, mixing, packing, secrets
from probelake.llm.common import cut, maybe_broadcast, shared_dir, table

#: Encoded pieces that a Python worker of the packing stage keeps: its memory is there beside that of other stages.
MEMO_ENTRIES = 150_000

_left = threading.local()


def staged(f: Callable) -> Callable:
    """A stage that first deletes what the one before left in the shared folder, and remembers what it writes itself."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        with common.collecting(_left.paths):
            return f(spark, docs, sf_dir)

    return run


def sweep(spark: SparkSession) -> None:
    for path in getattr(_left, "paths", ()):
        common.remove(spark, path)
    _left.paths = []


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(docs).filter("hr_kept").select(*docs.columns)


@staged
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    by_text = F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseAND((1 << 61) - 1).bitwiseOR(1 << 62)
    key = F.coalesce(F.col("doc_id").cast("long"), by_text)
    found = cut(jaccard.near_duplicates(docs.select(key.alias("key"), "text"), "key"))
    goes = cut(found.filter("key <> component_id").select("key").distinct())
    stay = docs.join(maybe_broadcast(goes), key == goes["key"], "left_anti")
    again = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    if not again.limit(1).count():
        return stay.select(*docs.columns)
    twice = stay.join(maybe_broadcast(again), key == again["key"], "left_semi")
    one = Window.partitionBy(key, F.coalesce("text", F.lit(""))).orderBy(*[F.col(c) for c in docs.columns])
    twice = twice.withColumn("dd_at", F.row_number().over(one)).filter("dd_at = 1").select(*docs.columns)
    return stay.join(maybe_broadcast(again), key == again["key"], "left_anti").select(*docs.columns).unionByName(twice)


@staged
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(secrets.scan(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@staged
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, memo=MEMO_ENTRIES)


STAGES = [("quality_rules", quality), ("jaccard_join", near_copies), ("secret_scan", without_secrets), ("source_mix", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The rows of the last stage.

    With a ``run_id``, a run that a lost driver broke off goes on after its last finished stage. A stage's input goes
    once its result is written; the last result stays for the caller, until the driver ends if there is no ``run_id``.
    """
    common.bounded_batches(spark)
    top = f"{shared_dir(spark)}/probelake/pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{top}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    fs, jtop = common.path_of(spark, top)
    if not run_id:
        fs.deleteOnExit(jtop)
    done = max((k for k, p in enumerate(paths) if fs.exists(common.path_of(spark, f"{p}/_SUCCESS")[1])), default=-1)
    docs = spark.read.parquet(paths[done]) if done >= 0 else table(spark, sf_dir, "documents")
    for k in range(done + 1, len(STAGES)):
        common.write(STAGES[k][1](spark, docs, sf_dir), paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            common.remove(spark, paths[k - 1])
    sweep(spark)
    return docs


#: Packing by a library's token ids can't be expressed in SQL.
ORACLE_SQL = None
