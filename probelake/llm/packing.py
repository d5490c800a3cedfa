"""Bounded-space online packing of token ids into sequences of a fixed length.

Each partition keeps a fixed number of open windows. Whole multiples of the length go out as they come; the rest of
a document goes to the window that it fits best. Where it fits none and all windows are in use, it first fills up
the fullest, which goes out, and its remainder is placed again. At its end a partition merges its open windows by
the same rule into full ones and one that is part full; those meet by groups of partitions in a second step. So
only one sequence of each such group is padded.

Null text counts as empty: one piece, the end id alone. Repeated rows are packed each. A very long text gives many whole
sequences. Of windows that fit equally well the one opened first is taken. Empty tables give none. Only the id and the
text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import MEMO_ENTRIES, Encoder, tokenizer_path

LENGTH, WINDOWS, MERGE, END = 4096, 64, 64, 2
COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Places pieces (id, start, ids, doc_tokens); ``out`` gets rows of full sequences."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.most, self.next_id = length, windows, first_id
        self.open: list[tuple[int, int]] = []  # (free, key), ascending
        self.pieces: dict[int, list] = {}
        self.out: list[tuple] = []
        self.keys = 0

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def put(self, at: int, piece: tuple) -> None:
        """Into the window at this place of ``open``; a full one goes out."""
        free, key = self.open.pop(at)
        self.pieces[key].append(piece)
        free -= len(piece[2]) // 4
        if free:
            insort(self.open, (free, key))
        else:
            self.emit(self.pieces.pop(key))

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size = 4 * self.length
        while len(ids) >= size:
            self.emit([(doc, start, ids[:size], total)])
            start, ids = start + self.length, ids[size:]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):
                return self.put(at, (doc, start, ids, total))
            if len(self.open) < self.most:
                self.keys += 1
                self.pieces[self.keys] = []
                insort(self.open, (self.length, self.keys))
                continue
            free = self.open[0][0]
            self.put(0, (doc, start, ids[: 4 * free], total))
            start, ids = start + free, ids[4 * free :]

    def close(self) -> list:
        """The pieces of the one window that is left after merging all that are open; the others go out."""
        last, self.most = [p for _, key in self.open for p in self.pieces[key]], 1
        self.open, self.pieces = [], {}
        for p in last:
            self.add(*p)
        return [p for _, key in self.open for p in self.pieces[key]]


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, windows: int = WINDOWS, end: int = END, memo: int = MEMO_ENTRIES) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``memo``: see ``Encoder``."""
    kind = df.schema[id].dataType.simpleString()
    tail = end.to_bytes(4, "little")
    names = [id, *COLUMNS, "pk_part", "pk_ids"]
    fields = f"`{id}` {kind}, " + ", ".join(f"{c} long" for c in COLUMNS) + ", pk_part long, pk_ids binary"

    def block(rows: list, kind_of: pa.DataType, part=None) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[] for _ in range(len(COLUMNS) + 1 + bool(part is not None))]
        arrays = [pa.array(cols[0], kind_of)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
        arrays += [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())] if part is None else [pa.array([part] * len(rows), pa.int64()), pa.array(cols[7], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        encoder, part, kind_of = Encoder.at(path or tokenizer_path(), memo), TaskContext.get().partitionId(), pa.int64()
        packer = Packer(length, windows, part << 32)
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for doc, t in zip(batch.column(0), batch.column(1)):
                ids = encoder.ids(t.as_py() or "") + tail
                packer.add(doc.as_py(), 0, ids, len(ids) // 4)
            if packer.out:
                yield block(packer.out, kind_of)
                packer.out = []
        left = packer.close()
        if packer.out:
            yield block(packer.out, kind_of)
        if left:
            yield block([(d, s, len(i) // 4, 0, t, k, 0, i) for k, (d, s, i, t) in enumerate(left)], kind_of, part)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(length, 1, (1 << 62) | (int(key[0]) << 32))
        rows = rows.sort_values(["pk_part", "sequence_id"])
        for doc, start, ids, total in zip(rows[id], rows["start"], rows["pk_ids"], rows["doc_tokens"]):
            packer.add(doc, int(start), bytes(ids), int(total))
        for key_ in [k for _, k in packer.open]:
            packer.emit(packer.pieces[key_])
        return pd.DataFrame(packer.out, columns=[id, *COLUMNS])

    packed = cut(df.select(F.col(id), F.col(text)).mapInArrow(run, fields))
    full = packed.filter("pk_part is null").drop("pk_part", "pk_ids")
    left = packed.filter("pk_part is not null").groupBy(F.floor(F.col("pk_part") / MERGE).alias("pk_group"))
    return full.unionByName(left.applyInPandas(merge, f"`{id}` {kind}, " + ", ".join(f"{c} long" for c in COLUMNS)))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pack": op8_pack}
ORACLES: dict[str, str] = {}
