"""Streaming: mapping new FASTQ-derived read files as they land. Later steps need a whole cell and stay batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import map_reads

READS = "read_id long, r1 string, q1 string, r2 string, q2 string"


def stream_mapped(spark: SparkSession, reads_path: str, out_path: str, checkpoint: str, manifest: DataFrame, cells: DataFrame, **options) -> StreamingQuery:
    """Maps each micro-batch of Parquet read files into a folder of its own number, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        map_reads(df, manifest, cells, **options).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    reads = spark.readStream.schema(READS).parquet(reads_path)
    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
