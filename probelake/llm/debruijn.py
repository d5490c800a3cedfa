"""Substring dedup over the de Bruijn graph of word windows, compacted into nonbranching paths.

A window of 35 words is an edge, between the 34-word sequences that it starts and ends with. To list every edge would
take several times the text's own size, so edges come in runs: each document is cut into maximal runs of windows that
share their minimizer (the window's least 8-word hash, its first occurrence), a run known by its minimizer and the hash
of all its words. Equal windows have equal minimizers, so all that can be equal meets. A run found twice repeats all its
edges; a minimizer with one run repeats none; only where one minimizer has several runs may the graph branch, and only
those are opened, one copy of each, into windows that are compared one by one.

Repeated runs are then compacted: each occurrence knows marks of the runs before and after it, and where all
occurrences of a run have the same neighbour the graph doesn't branch. So a document's repeated runs are joined, by its
key, into nonbranching paths, cut where neighbours differ and where repeats end: a passage shared by many texts is one
path with one row a text, however long it is.

Hashes (of 96 bits) only propose. Paths and windows go back to the words at their source coordinates: only those whose
words, by a 128-bit cryptographic digest, are found twice are repeats. A path that no other equals, as marks may
collide, is taken apart into its runs, which are compared with all occurrences of theirs in the same way.

Runs found often in one task's chunk of rows are hot: they are known to be repeated, go anywhere at random, and one of
them goes to where their other occurrences meet. Minimizers of many runs are dealt out by run. So no task gets all
rows of a hot run or minimizer. Windows are judged on the input alone.

Rows are known by a hash of id and text, so null ids and ids that repeat with other texts are rows like others; equal
rows are copies, and each gets its row. Null text has no words; texts of fewer words than a window lose none. Very
long texts are taken whole. Empty tables give empty results. Only the id and the text are read, so other columns'
names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, maybe_broadcast, table
from .hashing import U, mixed, run_hashes, sliding_first_min, window_hashes, word_hashes

WINDOW, KMER = 35, 8
#: Occurrences in a chunk of so many rows that make a run hot; the share and number of all rows that make a minimizer hot.
HOT, CHUNK = 16, 1 << 18
HOT_SHARE, HOT_LEAST = 50_000, 1000
#: Marks of neighbours: what is beyond a text's end, and what differs among the rows that a row stands for.
NONE, SEVERAL = 1 << 16, (1 << 16) + 1
_OTHER = U(0xA0761D6478BD642F)
RUN = ["m", "s1", "s2", "n"]


def _bytes(t) -> bytes:
    return (t.as_py() or "").encode("utf-8", "surrogatepass")


def keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.xxhash64(id, text).alias("db_key"), F.col(id).alias("db_id"), F.col(text).alias("db_text"))


def runs(texts: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(m, s1, s2, n, before, after, key, first, kind): runs of n windows, marks of their neighbours, and where they start.

    kind: 0; 1 if hot; 2 for a copy of a hot one that stands for its chunk's.
    """
    names = [*RUN, "before", "after", "key", "first", "kind"]

    def dealt(parts):
        m, s1, s2, n, before, after, key, first = (np.concatenate(x) for x in zip(*parts))
        _, some, of, counts = np.unique(s1, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(of, kind="stable")
        starts = np.cumsum(counts) - counts
        often = counts > HOT
        one = lambda x: np.where(np.minimum.reduceat(x[order], starts) == np.maximum.reduceat(x[order], starts), x[some], SEVERAL)
        hot = often[of]
        # Hashes of 64 bits choose what is hot; where the rest differs, the rows are left as they are.
        for x in (m, s2, n):
            hot &= (np.minimum.reduceat(x[order], starts) == np.maximum.reduceat(x[order], starts))[of]
        b, a = one(before), one(after)
        before, after = np.where(hot, b[of], before), np.where(hot, a[of], after)
        stand = some[often & hot[some]]
        cols = [np.concatenate([x, x[stand]]) for x in (m, s1, s2, n, before, after, key, first)]
        cols.append(np.concatenate([hot.astype(np.int8), np.full(len(stand), 2, np.int8)]))
        for i in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in cols], names=names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = word_hashes(_bytes(t))
                if len(h) < window:
                    continue
                k = window_hashes(h, kmer)
                at = sliding_first_min(k, window - kmer + 1)
                first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                n = np.diff(np.append(first, len(at)))
                s1 = run_hashes(h, first, first + n + window - 1)
                s1 = mixed(s1 + (at[first] - first).astype(np.uint64))
                s2 = run_hashes(mixed(h ^ _OTHER), first, first + n + window - 1)
                mark, end = (s1 >> U(48)).astype(np.int32), np.full(1, NONE, np.int32)
                parts.append((
                    k[at[first]].view(np.int64), s1.view(np.int64), (s2 >> U(32)).astype(np.uint32).view(np.int32), n.astype(np.int32),
                    np.concatenate([end, mark[:-1]]), np.concatenate([mark[1:], end]), np.full(len(n), key, np.int64), first.astype(np.int32),
                ))
                held += len(n)
                if held >= CHUNK:
                    yield from dealt(parts)
                    parts, held = [], 0
        if held:
            yield from dealt(parts)

    return texts.select("db_key", "db_text").mapInArrow(run, "m long, s1 long, s2 int, n int, before int, after int, key long, first int, kind byte")


def judged(found: DataFrame) -> DataFrame:
    """Rows of ``runs`` that are repeated or may branch: twice, branch (one copy of each run that may), opens, ends."""
    hot = found.filter("kind = 1").withColumns({"twice": F.lit(True), "branch": F.lit(False), "opens": F.col("before") >= NONE, "ends": F.col("after") >= NONE})
    rest = found.filter("kind <> 1")
    limit = max(HOT_LEAST, found.count() // HOT_SHARE)
    many = rest.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > limit).select("m", F.ceil(F.col("c") / limit).alias("salts"))
    salted = rest.join(F.broadcast(cut(many)), "m", "left")  # HOT_SHARE rows at most
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("s1", "s2", "n"), F.col("salts")), F.lit(0)).cast("int"))
    group = Window.partitionBy("m", "salt")
    w, equal = group.orderBy("s1", "s2", "n"), Window.partitionBy("m", "salt", "s1", "s2", "n")
    same = lambda f: F.coalesce((f("s1").over(w) == F.col("s1")) & (f("s2").over(w) == F.col("s2")) & (f("n").over(w) == F.col("n")), F.lit(False))
    key = F.struct("s1", "s2", "n")
    differs = lambda c: (F.min(c).over(equal) != F.max(c).over(equal)) | (F.max(c).over(equal) >= NONE)
    out = salted.withColumns({"prior": same(F.lag), "next": same(F.lead), "lo": F.min(key).over(group), "hi": F.max(key).over(group), "opens": differs("before"), "ends": differs("after")})
    out = out.withColumn("twice", F.col("prior") | F.col("next") | (F.col("kind") == 2))
    out = out.withColumn("branch", (F.col("salts").isNotNull() | (F.col("lo") != F.col("hi"))) & ~F.col("prior"))
    names = [*RUN, "key", "first", "twice", "branch", "opens", "ends"]
    return out.select(*names).union(hot.select(*names)).filter("twice or branch")


def _opened(texts: DataFrame, window: int) -> DataFrame:
    """(w1, w2, key, at, sure): hashes of the windows of (db_key, db_text, path), whose runs may be known to repeat."""

    def run(batches):
        for batch in batches:
            w1, w2, key, at, sure = [], [], [], [], []
            for k, t, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                h = word_hashes(_bytes(t))
                a, b = window_hashes(h, window), window_hashes(mixed(h ^ _OTHER), window)
                for x in path:
                    p = np.arange(x["first"], min(len(a), x["first"] + x["n"]))
                    w1.append(a[p]), w2.append(b[p]), at.append(p), key.append(np.full(len(p), k)), sure.append(np.full(len(p), x["twice"]))
            if w1:
                w1, w2, key, at, sure = (np.concatenate(x) for x in (w1, w2, key, at, sure))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array((w2 >> U(32)).astype(np.uint32).view(np.int32)), pa.array(key.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(sure.astype(bool))], names=["w1", "w2", "key", "at", "sure"]
                )

    return texts.mapInArrow(run, "w1 long, w2 int, key long, at int, sure boolean")


def paths(rows: DataFrame) -> DataFrame:
    """(key, first, n): a row's repeated runs (key, first, n, opens, ends) compacted into nonbranching paths."""

    def run(batches):
        keep = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if keep is not None:
                cols = [np.concatenate(x) for x in zip(keep, cols)]
            if len(cols[0]):
                last = cols[0] == cols[0][-1]
                keep = [c[last] for c in cols]
                yield from settle(*(c[~last] for c in cols))
        if keep is not None:
            yield from settle(*keep)

    def settle(key, at, n, opens, ends):
        if not len(key):
            return
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (at[1:] == at[:-1])])  # of equal rows, and of copies that stand for hot ones
        key, at, n, opens, ends = (x[~same] for x in (key, at, n, opens, ends))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + n[:-1]) | opens[1:] | ends[:-1]])
        first = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(at[first]), pa.array(np.add.reduceat(n, first).astype(np.int32))], names=["key", "first", "n"])

    return rows.select("key", "first", "n", "opens", "ends").repartition("key").sortWithinPartitions("key", "first", F.desc("opens"), F.desc("ends")).mapInArrow(run, "key long, first int, n int")


def digests(texts: DataFrame, window: int) -> DataFrame:
    """(digest, key, first, n, kind) of the words of (db_key, db_text, path)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, t, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ws = _bytes(t).split()
                for x in path:
                    end = x["first"] + x["n"] + window - 1
                    if end <= len(ws):
                        digest = hashlib.blake2b(b" ".join(ws[x["first"] : end]), digest_size=16).digest()
                        for col, v in zip(out, (digest, key, x["first"], x["n"], x["kind"])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["digest", "key", "first", "n", "kind"])

    return texts.mapInArrow(run, "digest binary, key long, first int, n int, kind int")


def repeats(texts: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(key, path): for each row of ``keyed`` with any, the (first, n) of windows that also start elsewhere."""
    found = cut(runs(texts, window, kmer))
    known = cut(judged(found))
    discard(found)

    def at(rows: DataFrame, *cols: str) -> DataFrame:
        """(db_key, db_text, path) for rows (key, cols); of equal rows of the table, each. Paths grow with the table: never broadcast."""
        chosen = rows.groupBy("key").agg(F.collect_list(F.struct(*cols)).alias("path"))
        return texts.join(chosen.hint("merge"), F.col("db_key") == F.col("key")).select("db_key", "db_text", "path")

    opened = cut(_opened(at(known.filter("branch"), "first", "n", "twice"), window))
    several = opened.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w1", "w2")
    single = cut(opened.join(several, ["w1", "w2"], "left_semi").select("key", F.col("at").alias("first"), F.lit(1).alias("n"), F.when(F.col("sure"), 2).otherwise(1).alias("kind")).distinct())
    discard(opened)
    made = cut(paths(known.filter("twice")))
    seen = cut(digests(at(made.withColumn("kind", F.lit(0)).unionByName(single), "first", "n", "kind"), window))
    discard(single)
    counts = seen.groupBy("digest", "n", (F.col("kind") > 0).alias("window")).agg(F.count(F.lit(1)).alias("c"))
    once = cut(counts.filter("c = 1").select("digest", "n", "window"))  # counted before the shuffle, and few: most that is proposed is right
    sure = cut(seen.withColumn("window", F.col("kind") > 0).join(maybe_broadcast(once), ["digest", "n", "window"], "left_anti").filter("kind < 2").select("key", "first", "n", "kind").distinct())
    alone = made.join(sure.filter("kind = 0"), ["key", "first", "n"], "left_anti")
    alone = cut(alone.select("key", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi")))
    spans = sure.select("key", "first", "n")
    if alone.limit(1).count():
        twice = known.filter("twice")
        parts = twice.join(maybe_broadcast(alone), "key").filter("first >= lo and first < hi").select(*RUN).distinct()
        every = twice.join(maybe_broadcast(cut(parts)), RUN, "left_semi").select("key", "first", "n", F.lit(0).alias("kind")).distinct()
        again = cut(digests(at(every, "first", "n", "kind"), window))
        more = again.groupBy("digest", "n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest", "n")
        spans = spans.unionByName(again.join(more, ["digest", "n"], "left_semi").select("key", "first", "n"))
    out = cut(spans.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("path")))
    discard(known, made, seen)
    return out


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): kept words joined by one space, for each row."""
    kind = df.schema[id].dataType.simpleString()
    texts = keyed(df, id, text)
    texts = texts.join(repeats(texts, window).hint("merge"), F.col("db_key") == F.col("key"), "left").select("db_id", "db_text", "path")
    names = [id, "n_words", "n_removed", "kept"]

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for t, found in zip(batch.column(1), batch.column(2)):
                ws = _bytes(t).split()
                n.append(len(ws))
                found = found.as_py()
                if found:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    first = np.array([x["first"] for x in found])
                    end = first + np.array([x["n"] for x in found]) + window - 1
                    inside = end <= len(ws)
                    np.add.at(edge, first[inside], 1)
                    np.add.at(edge, end[inside], -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone.append(int(len(ws) - stay.sum()))
                    ws = [ws[i] for i in np.flatnonzero(stay)]
                else:
                    gone.append(0)
                kept.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=names)

    return texts.mapInArrow(run, f"`{id}` {kind}, n_words long, n_removed long, kept string")


def op7_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op7_debruijn": op7_debruijn}
ORACLES = {
    "op7_debruijn": r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) s from (select doc_id, ws, unnest(range(1, len(ws) - 33)) i from w)),
twice as (select s from win group by s having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) p from win semi join twice using (s)),
pos as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) k, count(*) n from pos anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(k, '')) kept_sha256 from w left join kept using (doc_id)"""
}
