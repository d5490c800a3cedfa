"""What the two text classifiers share: samples of labelled rows of a documented size, and scoring in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id: str, mod: int) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % mod


def first_by_hash(ids: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """A sample of at most ``n`` ids, the same at every run."""
    return ids.select(id).distinct().orderBy(F.xxhash64(id, F.lit(seed)), id).limit(n)


def score(df: DataFrame, id: str, text: str, held_out: Column, threshold: float, make) -> DataFrame:
    """id, held_out, score, predicted; ``make()`` gives a function from text to score, once a task."""
    kind = df.schema[id].dataType.simpleString()
    names = [id, "held_out", "score", "predicted"]

    def run(batches):
        f = make()
        for batch in batches:
            s = [f(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=names
            )

    texts = df.select(F.col(id), held_out.alias("held_out"), F.col(text))
    return texts.mapInArrow(run, f"`{id}` {kind}, held_out boolean, score double, predicted int")
