"""Jaccard join on word shingles by extended token prefixes, and the components of its links.

A document's set holds its distinct five-word shingles (A-Z lowered), as 64-bit hashes. Documents of equal sets are
one class, named by its least id. Tokens are taken in the order of their hashes. Two sets of Jaccard 3/4 or more that
share o tokens share at least k of them within the first n - o + k of each: classes are indexed on that extended
prefix, k being a share of n. Postings of at most ``RARE`` classes give all their pairs.

Longer postings belong to frequent tokens. A class with fewer than k of them needs no more, as a partner shares k
tokens with it of which one is rare. The others are indexed again among themselves with frequent tokens last, which
a fixed-size bitmap tells, so that their prefixes extend over rarer ones. There, sets of up to ``COMBINE`` tokens are
indexed on single tokens where those are rare and on combinations of two where they are frequent: the first two
tokens that partners share lie in both prefixes for k = 2. Larger sets have too many combinations and keep single
ones (sets just below the bound are in both indexes). Combinations that are still frequent, as those of a large
group of near copies or of a passage that many texts share, tell nobody apart: only classes that have some are taken
as families (what shares frequent entries, directly or through others) and compared in blocks, where all shared
tokens of a pair are counted at once. Every candidate is verified on the whole sets, over all 64 bits.

A token that is frequent within a task's chunk of rows is known to be so before the shuffle: its rows are dealt out at
random and only a mark of it goes to where the token's other rows meet, so no task gets all rows of a hot token.

Null or wordless text has an empty set and no links; with fewer than five words the whole sequence is the one
shingle. Very long texts are whole sets; families are cut into blocks by bytes as well as by number. Rows that repeat
an id are taken as one document and each get their row; a null id links with nothing. Equal sizes and hashes need no
tie-break, as classes are named by least ids. Columns but the id and the text are not read, so their names can't
clash. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, maybe_broadcast, table
from .components import components
from .hashing import U, mixed, window_hashes, word_hashes

SHINGLE, PERCENT = 5, 75
RARE, EXTEND, COMBINE, BLOCK, BLOCK_BYTES, DENSE = 16, 16, 256, 1024, 4 << 20, 4096
BITS = 24
#: Prefix rows that are looked through for hot tokens at once, and products of rows that are counted at once.
CHUNK, STEP = 1 << 20, 1 << 21
MARK = -(1 << 63)


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"), lower=True)
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(SHINGLE, len(h))) ^ U(min(SHINGLE, len(h))))


def extension(n):
    """k: how many shared tokens a prefix of a set of n answers for."""
    return np.maximum(1, n // EXTEND)


def prefix_size(n: int) -> int:
    return min(n, n - -(-PERCENT * n // 100) + int(extension(n)))


def classes_of(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, c1, c2): size and digest of each document's set."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, c1, c2 = [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py())
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                c1.append(int.from_bytes(d[:8], "little", signed=True))
                c2.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], names=[id, "n", "c1", "c2"])

    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, n long, c1 long, c2 long")


def entries(s: np.ndarray, late: np.ndarray | None) -> np.ndarray:
    """What a class is indexed on: its extended prefix, or with ``late`` (the frequent slots) also combinations.

    With ``late``, the lowest bit tells entries of large sets (1) from those of small ones (0), which are kept apart.
    """
    n = len(s)
    if late is None:
        return s[: prefix_size(n)]
    often = late[s >> U(64 - BITS)].astype(bool)
    order = np.argsort(often, kind="stable")
    s, often, out = s[order], often[order], []
    if n <= COMBINE:
        short = min(n, n - -(-PERCENT * n // 100) + 2)
        rare, busy = s[:short][~often[:short]], s[:short][often[:short]]
        i, j = np.triu_indices(len(busy), 1)
        with np.errstate(over="ignore"):
            both = mixed(busy[i] * U(0x9E3779B97F4A7C15) + mixed(busy[j]))
        out.append(np.concatenate([rare, both]) & ~U(1))
    if 4 * n > 3 * COMBINE:
        out.append(s[: prefix_size(n)] | U(1))
    return np.unique(np.concatenate(out))


def prefixes(docs: DataFrame, frequent: bytes | None = None) -> DataFrame:
    """(tok, rep, n, hot) over each document's entries; with ``frequent``, tokens of that bitmap come last.

    ``hot``: the token is known to be frequent from this task alone. Of each such token there is one more row that
    isn't hot, with rep ``MARK``, for those who meet its other rows.
    """
    bits = docs.sparkSession.sparkContext.broadcast(frequent) if frequent else None

    def dealt(toks, reps, sizes):
        tok, rep, n = (np.concatenate(x) for x in (toks, reps, sizes))
        kinds, of, counts = np.unique(tok, return_inverse=True, return_counts=True)
        often = counts > RARE
        marks = kinds[often]
        hot = np.concatenate([often[of], np.zeros(len(marks), bool)])
        tok, rep, n = np.concatenate([tok, marks]), np.concatenate([rep, np.full(len(marks), MARK)]), np.concatenate([n, np.zeros(len(marks), np.int32)])
        for i in range(0, len(tok), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (tok, rep, n, hot)], names=["tok", "rep", "n", "hot"])

    def run(batches):
        late = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little") if bits else None
        toks, reps, sizes, held = [], [], [], 0
        for batch in batches:
            for rep, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(t.as_py())
                if not len(s):
                    continue
                e = entries(s, late)
                toks.append(e.view(np.int64))
                reps.append(np.full(len(e), rep, np.int64))
                sizes.append(np.full(len(e), len(s), np.int32))
                held += len(e)
                if held >= CHUNK:
                    yield from dealt(toks, reps, sizes)
                    toks, reps, sizes, held = [], [], [], 0
        if held:
            yield from dealt(toks, reps, sizes)

    return docs.mapInArrow(run, "tok long, rep long, n int, hot boolean")


def postings(rows: DataFrame) -> DataFrame:
    """From (tok, rep, n, hot): pairs of rare tokens (0, a, b, times met) and rows of frequent ones (1, tok, rep, n).

    One shuffle, by token but for hot rows, which go anywhere; then a stream over sorted rows that holds at most RARE
    rows of a token.
    """

    def run(batches):
        keep = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        hot = None  # the token of a posting known to be frequent, whose rows go straight out
        for batch in batches:
            known = batch.column(3).to_numpy(zero_copy_only=False)
            cols = [c.to_numpy() for c in batch.columns[:3]]
            if known.any():
                yield out(1, *(c[known] for c in cols))
            tok, rep, n = (np.concatenate([k, c[~known]]) for k, c in zip(keep, cols))
            if len(tok):
                yield from settle(tok, rep, n, hot, False)
                last = tok == tok[-1]
                if hot is not None and tok[-1] == hot or last.sum() > RARE or (rep[last] == MARK).any():
                    hot, keep = tok[-1], [x[:0] for x in (tok, rep, n)]
                else:
                    hot, keep = None, [x[last] for x in (tok, rep, n)]
        if len(keep[0]):
            yield from settle(*keep, hot, True)

    def settle(tok, rep, n, hot, end):
        cuts = np.flatnonzero(np.diff(tok)) + 1
        first, stop = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(tok)]])
        size = stop - first
        is_hot = (size > RARE) | (rep[first] == MARK)  # marks sort first
        if hot is not None and tok[0] == hot:
            is_hot[0] = True
        open_run = np.zeros(len(first), bool)
        open_run[-1] = not end
        for m in np.unique(size[~is_hot & ~open_run & (size > 1)]):
            runs = first[~is_hot & ~open_run & (size == m)]
            i, j = np.triu_indices(m, 1)
            x, y = (runs[:, None] + i).ravel(), (runs[:, None] + j).ravel()
            fits = (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & (rep[x] != rep[y])
            x, y = rep[x[fits]], rep[y[fits]]
            pairs, met = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1, return_counts=True)
            yield out(0, pairs[0], pairs[1], met.astype(np.int32))
        at = np.repeat(is_hot, size) & (rep != MARK)
        if at.any():
            yield out(1, tok[at], rep[at], n[at])

    def out(kind, x, y, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(n)], names=["kind", "x", "y", "n"])

    rows = rows.repartition(F.when(F.col("hot"), F.xxhash64("rep", "tok")).otherwise(F.col("tok")))
    return rows.sortWithinPartitions("hot", "tok", "rep").mapInArrow(run, "kind int, x long, y long, n int")


def sets_of(docs: DataFrame) -> DataFrame:
    """(rep, s): each set's tokens, ascending, 8 bytes each."""

    def run(batches):
        for batch in batches:
            s = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], names=["rep", "s"])

    return docs.mapInArrow(run, "rep long, s binary")


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard PERCENT or more."""

    def run(batches):
        for batch in batches:
            ok, one, ones = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != one:
                    one, ones = a, _unpack(x.as_py())
                other = _unpack(y.as_py())
                both = np.concatenate([ones, other])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= PERCENT * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    return with_b.mapInArrow(run, "a long, b long")


def _bitmap(toks: DataFrame) -> bytes:
    """A bit for each value of the upper BITS bits of the tokens (tok); of fixed size."""
    slot = F.call_function("shiftrightunsigned", F.col("tok"), F.lit(64 - BITS))
    words = toks.select(F.call_function("shiftrightunsigned", slot, F.lit(6)).alias("w"), slot.bitwiseAND(63).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    got = words.toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.tobytes()


def _busy(hot: DataFrame, combined: bool = False) -> DataFrame:
    """(rep, n) of classes that frequent tokens may still link; ``hot`` is (tok, rep, n).

    Those with as many as any partner shares with them in its prefix, or with one that is an entry of small sets.
    """
    limit = F.greatest(F.lit(1), F.floor(F.ceil(PERCENT * F.col("n") / 100) / EXTEND))
    large = F.col("tok").bitwiseAND(1) == 1 if combined else F.lit(True)
    counts = hot.groupBy("rep").agg(F.count_if(large).alias("m"), F.count_if(~large).alias("few"), F.max("n").alias("n"))
    return counts.filter((F.col("m") >= limit) | (F.col("few") > 0)).select("rep", "n")


def plausible(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``postings`` that can still reach PERCENT, from how many tokens their prefixes share.

    Tokens shared beyond the prefix that ends first number no more than its set has left there, and tokens shared
    within are those met in rare postings and at most the frequent ones of either.
    """
    hot = found.filter("kind = 1").groupBy(F.col("y").alias("rep")).agg(F.count(F.lit(1)).alias("m"))
    known = cut(sizes.select("rep", "n").join(hot, "rep", "left").select("rep", "n", F.coalesce("m", F.lit(0)).alias("m")))
    of = lambda c: maybe_broadcast(known).toDF(c, f"n{c}", f"m{c}")
    met = found.filter("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("n").alias("met"))
    met = met.join(of("a"), "a").join(of("b"), "b")
    left = lambda n: F.ceil(PERCENT * F.col(n) / 100) - F.greatest(F.lit(1), F.floor(F.col(n) / EXTEND))
    most = F.col("met") + F.least("ma", "mb") + F.greatest(left("na"), left("nb"), F.lit(0))
    return met.filter((100 + PERCENT) * most >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b")


def classes_and_links(df: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, n, rep), links (a, b) between class representatives that connect every component)."""
    docs = df.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("rep"), F.col(text))
    base = cut(classes_of(df, id, text))
    reps = base.filter(F.col(id).isNotNull() & (F.col("n") > 0)).groupBy("n", "c1", "c2").agg(F.min(id).cast("long").alias("rep"))
    reps = cut(reps)
    mapped = base.join(maybe_broadcast(reps), ["n", "c1", "c2"], "left").select(id, "n", "rep")

    def texts(chosen: DataFrame) -> DataFrame:
        return docs.join(maybe_broadcast(chosen), "rep", "left_semi")

    def hot_of(found: DataFrame) -> DataFrame:
        return found.filter("kind = 1").select(F.col("x").alias("tok"), F.col("y").alias("rep"), "n")

    first = cut(postings(prefixes(texts(reps.select("rep")))))
    pairs = plausible(first, reps)
    busy, again, hot = cut(_busy(hot_of(first))), None, None
    if busy.limit(1).count():  # frequent tokens last and combined, among the classes that have many
        again = cut(postings(prefixes(texts(busy.select("rep")), _bitmap(hot_of(first).select("tok")))))
        pairs = pairs.union(again.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
        hot = hot_of(again)
        hot = cut(hot.join(maybe_broadcast(cut(_busy(hot, True).select("rep"))), "rep", "left_semi"))
    pairs = cut(pairs.distinct())
    discard(first, *([again] if again else []))
    some = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
    if hot is not None:
        some = some.union(hot.select("rep"))
    sets = cut(sets_of(texts(cut(some.distinct()))))
    links = cut(verified(pairs, sets))
    if hot is not None and hot.limit(1).count():
        links = links.union(cut(family_links(hot, sets)))
        discard(hot)
    discard(sets, pairs)
    return mapped, links


def family_links(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is linked among classes with frequent entries; ``hot`` is (tok, rep, n).

    Classes that share frequent entries, directly or through others, are a family. A family is cut into blocks of
    BLOCK classes and BLOCK_BYTES at most, about, and a task gets two blocks: it counts shared tokens of all their
    pairs in matrices and returns a spanning forest of the links, so no pairs are emitted and a task's size is fixed.
    """
    least = cut(hot.groupBy("tok").agg(F.min("rep").alias("b")))
    shared = hot.join(maybe_broadcast(least), "tok").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    families = components(cut(shared))
    rows = families.withColumnRenamed("node", "rep").join(sets, "rep")
    blocks = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("s")) / BLOCK_BYTES)
    sizes = cut(rows.groupBy("comp").agg(F.ceil(blocks).cast("int").alias("blocks")))
    rows = rows.join(maybe_broadcast(sizes), "comp")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "s")
    return rows.groupBy("comp", "i", "j").applyInPandas(_block_links, "a long, b long")


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    sides = []
    for block in (i, j):
        part = rows[rows["own"] == block].drop_duplicates("rep").sort_values("rep")
        sides.append((part["rep"].to_numpy(), [_unpack(bytes(x)) for x in part["s"]]))
    (ra, sa), (rb, sb) = sides
    if not len(ra) or not len(rb):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    linked = similar(sa, sb)
    if i == j:
        np.fill_diagonal(linked, False)
    found = forest(linked, i == j)
    return pd.DataFrame({"a": [ra[x] for x, _ in found], "b": [rb[y] for _, y in found]}, dtype="int64")


def similar(sa: list[np.ndarray], sb: list[np.ndarray]) -> np.ndarray:
    """Which pairs of two lists of sets have Jaccard PERCENT or more."""
    na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
    toks, where = np.unique(np.concatenate([*sa, *sb]), return_inverse=True)
    wa, wb = where[: na.sum()], where[na.sum() :]
    oa, ob = np.repeat(np.arange(len(sa)), na), np.repeat(np.arange(len(sb)), nb)
    ca, cb = np.bincount(wa, minlength=len(toks)), np.bincount(wb, minlength=len(toks))
    shared = np.zeros((len(sa), len(sb)), np.float32)
    dense = np.flatnonzero(ca * cb > DENSE)
    for first in range(0, len(dense), 512):  # tokens of many pairs: as matrix products
        cols = np.full(len(toks), -1)
        cols[dense[first : first + 512]] = np.arange(len(dense[first : first + 512]))
        x, y = np.zeros((len(sa), 512), np.float32), np.zeros((len(sb), 512), np.float32)
        ka, kb = cols[wa] >= 0, cols[wb] >= 0
        x[oa[ka], cols[wa[ka]]] = 1
        y[ob[kb], cols[wb[kb]]] = 1
        shared += x @ y.T
    few = (ca > 0) & (cb > 0) & (ca * cb <= DENSE)
    ka, kb = few[wa], few[wb]
    ta, da, tb, db = wa[ka], oa[ka], wb[kb], ob[kb]
    order = np.argsort(tb, kind="stable")
    tb, db = tb[order], db[order]
    begin, n = np.searchsorted(tb, ta), cb[ta]
    parts = np.searchsorted(np.cumsum(n), np.arange(STEP, n.sum() + STEP, STEP))
    for i, j in zip(np.append(0, parts), np.append(parts, len(ta))):  # so many products at once
        m = n[i:j]
        at = np.repeat(begin[i:j] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        flat = np.repeat(da[i:j], m) * len(sb) + db[at]
        shared += np.bincount(flat, minlength=shared.size).reshape(shared.shape)
    return 100 * shared >= PERCENT * (na[:, None] + nb[None] - shared)


def forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of a boolean link matrix, rows to columns; ``same``: rows and columns are the same nodes."""
    rows, cols = np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool)
    if same:
        cols = rows
    out = []
    for start in range(len(rows)):
        if rows[start]:
            continue
        rows[start] = True
        todo = [(start, True)]
        while todo:
            x, is_row = todo.pop()
            new = np.flatnonzero((linked[x] if is_row else linked[:, x]) & ~(cols if is_row else rows))
            (cols if is_row else rows)[new] = True
            out += [(x, y) if is_row else (y, x) for y in new.tolist()]
            todo += [(y, same or not is_row) for y in new.tolist()]
    return out


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row."""
    mapped, links = classes_and_links(df, id, text)
    comps = components(cut(links))
    out = mapped.join(maybe_broadcast(comps), F.col("rep") == F.col("node"), "left")
    return out.select(id, F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", F.col(id).cast("long")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES = {
    "op6_jaccard_join": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) i from w)),
n as (select doc_id, count(*) n from s group by 1),
links as (select a.doc_id a, b.doc_id b from s a join s b using (g) join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach as (select doc_id a, doc_id b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(reach.b) component_id from w left join n using (doc_id) join reach on reach.a = w.doc_id group by w.doc_id"""
}
