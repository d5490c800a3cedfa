"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (by UTF-8 bytes, of ``ORDERS``) of its lower-cased words, each word between
spaces, hashed to ``SLOTS`` slots. Over the training texts each slot has the log ratio of its smoothed shares in toxic
and other texts; slots whose shares differ by less than ``LEAST_Z`` standard errors are left out, as most n-grams are
chance. A logistic model is trained on presence times ratio. A Platt scale fitted on training rows that were
left out of the fit makes scores probabilities.

Fitted on samples of at most ``TOXIC`` and ``OTHERS`` labelled documents, chosen by a hash of their ids from rows that
are not held out; every document is scored. Slots are counted on executors, and only significant ones reach the driver.
Without labels of both kinds the score is the share of toxic ones. Null text counts as empty and is scored like it;
very long texts are scored whole; repeated rows are scored each, equal texts alike; empty tables give empty results.
Columns but id, text and label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table
from .linear import Adam, platt, sigmoid
from .scoring import first_by_hash, remainder, score

TOXIC, OTHERS, ORDERS, SLOTS, LEAST_Z = 2000, 3000, (4, 5, 6), 1 << 20, 4.5
THRESHOLD, MOD, HELD_OUT, FOLDS, TASKS = 0.7, 3, 1, 3, 4
EPOCHS, BATCH, RATE, DECAY, SMOOTH = 40, 128, 0.02, 1e-5, 0.5


def ngrams(text: str) -> np.ndarray:
    """Slots of a text's n-grams, with repeats."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h * np.uint32(0x01000193)) ^ b[i : len(b) - n + 1 + i]
        h *= np.uint32(0x9E3779B1)
        out.append(h >> np.uint32(32 - SLOTS.bit_length() + 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def significant(n1, n0, toxic, other, sqrt=np.sqrt, abs_=np.abs):
    """Whether a slot's shares in toxic and other texts differ by LEAST_Z standard errors; of numbers, arrays or columns."""
    share = (toxic + other) / (n1 + n0)
    error = sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-12
    return abs_(toxic / n1 - other / n0) >= LEAST_Z * error


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weight by slot, intercept). rows: distinct slots, all that are significant among them."""
    toxic, other = np.zeros(SLOTS), np.zeros(SLOTS)
    for r, t in zip(rows, y):
        (toxic if t else other)[r] += 1
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = np.log((toxic + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((other + SMOOTH) / (n0 + 2 * SMOOTH))
    ratio[~significant(n1, n0, toxic, other)] = 0
    used = np.flatnonzero(ratio)
    index = np.full(SLOTS, -1, np.int64)
    index[used] = np.arange(len(used))
    cols = [c[c >= 0] for c in (index[r] for r in rows)]
    scale = ratio[used]
    w, bias, rng = np.zeros(len(used) + 1), 0.0, np.random.default_rng(seed)
    adam = Adam(len(w), RATE)
    # Each class weighs half, so that the rare one is not drowned; the scale fitted later sets the odds right.
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            flat = np.concatenate([cols[i] for i in part]) if len(part) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(part)), [len(cols[i]) for i in part])
            z = np.bincount(of, w[flat] * scale[flat], minlength=len(part)) + w[-1]
            g = (sigmoid(z) - y[part]) * weight[part] / len(part)
            grad = np.bincount(flat, g[of] * scale[flat], minlength=len(w))
            grad[-1] += g.sum()
            adam.step(w, grad + DECAY * w)
    dense = np.zeros(SLOTS, np.float32)
    dense[used] = w[:-1] * scale
    return dense, float(w[-1])


def raw(rows: list[np.ndarray], dense: np.ndarray, bias: float) -> np.ndarray:
    return np.array([dense[r].sum(dtype=np.float64) + bias for r in rows])


def slot_counts(sample: DataFrame) -> DataFrame:
    """(slot, t0, o0, ...): toxic and other texts with a slot, by fold, of (nb_y, nb_fold, text); a task holds SLOTS counts of each."""
    names = [f"{c}{k}" for k in range(FOLDS) for c in "to"]

    def run(batches):
        counts = np.zeros((2 * FOLDS, SLOTS), np.int32)
        for batch in batches:
            for y, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                counts[2 * k + 1 - y, np.unique(ngrams(t.as_py() or ""))] += 1
        slots = np.flatnonzero(counts.any(0))
        for i in range(0, len(slots), 1 << 17):
            part = slots[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(c[part]) for c in counts]], names=["slot", *names])

    found = sample.repartition(TASKS).mapInArrow(run, "slot int, " + ", ".join(f"{c} int" for c in names))
    return found.groupBy("slot").agg(*[F.sum(c).cast("double").alias(c) for c in names])


def train(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The model, fitted on the driver from the significant slots of the sampled documents, which executors choose."""
    learn = labels.filter((remainder(id, MOD) != HELD_OUT) & F.col(label).isNotNull())
    chosen = first_by_hash(learn.filter(F.col(label) == 1), id, TOXIC, 0).withColumn("nb_y", F.lit(1))
    chosen = chosen.unionByName(first_by_hash(learn.filter(F.col(label) == 0), id, OTHERS, 1).withColumn("nb_y", F.lit(0)))
    chosen = chosen.withColumn("nb_fold", F.pmod(F.xxhash64(id, F.lit(5)), F.lit(FOLDS)).cast("int"))
    sample = cut(df.select(id, text).join(F.broadcast(chosen), id).select("nb_y", "nb_fold", F.col(text).alias("nb_text")))  # bounded by TOXIC and OTHERS
    counts = {r[label]: r["count"] for r in learn.groupBy(label).count().collect()}
    prior = (counts.get(1, 0) + 1) / (counts.get(1, 0) + counts.get(0, 0) + 2)
    sizes = {(r["nb_fold"], r["nb_y"]): r["count"] for r in sample.groupBy("nb_fold", "nb_y").count().collect()}
    n = lambda y, but=None: sum(v for (k, t), v in sizes.items() if t == y and k != but)
    if not n(1) or not n(0):
        return {"prior": prior}
    folds = [None, *[k for k in range(FOLDS) if 0 < n(1, k) and 0 < n(0, k)]]  # all rows, and all but a fold's
    total = lambda c, but: sum((F.col(f"{c}{k}") for k in range(FOLDS) if k != but), F.lit(0.0))
    wanted = F.lit(False)
    for k in folds:
        wanted = wanted | significant(n(1, k), n(0, k), total("t", k), total("o", k), F.sqrt, F.abs)
    slots = np.sort(slot_counts(sample).filter(wanted).select("slot").toArrow().column(0).to_numpy())  # of SLOTS at most

    def run(batches):
        for batch in batches:
            x = [np.intersect1d(ngrams(t.as_py() or ""), slots).astype("<u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["nb_y", "nb_fold", "nb_x"])

    got = sample.mapInArrow(run, "nb_y int, nb_fold int, nb_x binary").toArrow()
    packed = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), (v.as_py() for v in got.column(2))))  # the order of rows must not matter
    discard(sample)
    y, part, rows = np.array([k for k, _, _ in packed], float), np.array([k for _, k, _ in packed]), [np.frombuffer(v, "<u4") for _, _, v in packed]
    z, held = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in folds[1:]:  # scores of rows that a fit hasn't seen, for the scale
        w, bias = fit([rows[i] for i in np.flatnonzero(part != k)], y[part != k])
        at = np.flatnonzero(part == k)
        z[at], held[at] = raw([rows[i] for i in at], w, bias), True
    w, bias = fit(rows, y)
    a, b = platt(z[held], y[held])
    b += np.log(prior / (1 - prior)) - np.log(y.sum() / (1 - y).sum())
    return {"prior": prior, "w": w, "bias": bias, "a": a, "b": b}


def scorer(model: dict):
    if "w" not in model:
        return lambda text: float(model["prior"])
    w, mark = model["w"], np.zeros(SLOTS, np.int32)

    def f(text: str) -> float:
        h = ngrams(text)
        h = h[w[h] != 0]
        order = np.arange(len(h), dtype=np.int32)
        mark[h] = order
        h = h[mark[h] == order]  # each slot once
        z = w[h].sum(dtype=np.float64) + model["bias"]
        return float(sigmoid(np.float64(model["a"] * z + model["b"])))

    return f


def op10_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)  # SLOTS float32
    return score(docs, "doc_id", "text", remainder("doc_id", MOD) == HELD_OUT, THRESHOLD, lambda: scorer(shared.value))


QUERIES = {"op10_nb_toxicity": op10_nb_toxicity}
ORACLES: dict[str, str] = {}
