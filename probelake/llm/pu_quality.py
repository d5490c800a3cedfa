"""Quality by positive-unlabelled learning: the non-negative unbiased risk over trusted positives and web text.

Features are shares of bytes and of byte class pairs, and figures on repetition, case and lines, of the whole text.
A linear model minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss: positives are
labelled 1, the unlabelled are documents taken without their labels, and the prior is estimated from the labelled
rows. Where a minibatch's negative part falls below zero, the step goes against it instead. A Platt scale, fitted on
positives left out of the risk and on labelled negatives, makes scores probabilities.

Fitted on samples of at most ``POSITIVES``, ``NEGATIVES`` (for prior and scale) and ``UNLABELLED`` documents, chosen
by a hash of their ids from rows that are not held out; every document is scored. Without labels of both kinds the
score is the prior. Null text counts as empty and is scored like it; very long texts are scored whole; repeated rows
are scored each, equal texts alike; empty tables give empty results. Columns but id, text and label are not read.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linear import Adam, platt, sigmoid
from .scoring import first_by_hash, remainder, score

POSITIVES, NEGATIVES, UNLABELLED = 3000, 1500, 6000
THRESHOLD, MOD, HELD_OUT, CALIBRATE = 0.3, 5, 0, 5
EPOCHS, BATCH, RATE, DECAY = 60, 512, 0.02, 1e-4


def _classes() -> np.ndarray:
    kinds = np.full(256, 7, np.uint8)  # beyond ASCII
    for b in range(128):
        c = chr(b)
        kinds[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c == "\n" else 5 if c in ".,;:'\"-()?" else 6
    return kinds


CLASSES = _classes()


def features(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    k = CLASSES[b]
    bytes_ = np.sqrt(np.bincount(b, minlength=256) / max(1, len(b)))
    pairs = np.sqrt(np.bincount(8 * k[:-1] + k[1:], minlength=64) / max(1, len(b) - 1))
    ws = text.split()
    n = max(1, len(ws))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    more = [
        len(set(ws)) / n, sum(map(operator.eq, ws, ws[1:])) / n, len(set(zip(ws, ws[1:], ws[2:]))) / max(1, len(ws) - 2),
        sum(map(str.isupper, ws)) / n, sum(map(str.isalpha, ws)) / n, sum(map(len, ws)) / n / 10, np.log1p(len(ws)) / 10,
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 10, float(not ws),
    ]
    return np.concatenate([bytes_, pairs, more]).astype(np.float32)


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of the least non-negative risk."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.01
    p, u = ((x - mean) / scale for x in (positives, unlabelled))
    p, u = (np.hstack([np.clip(x, -8, 8), np.ones((len(x), 1))]).astype(np.float64) for x in (p, u))
    w = np.zeros(p.shape[1])
    adam, steps = Adam(len(w), RATE), max(1, len(u) // BATCH)
    mean_w, taken = np.zeros_like(w), 0
    for epoch in range(EPOCHS):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for i in range(steps):
            a, b = p[order_p[i::steps]], u[order_u[i::steps]]
            if not len(a) or not len(b):
                continue
            za, zb = a @ w, b @ w
            # loss(+) = log(1 + exp(-z)), loss(-) = log(1 + exp(z))
            grad_pos = -(a.T @ (1 - sigmoid(za))) / len(a)
            grad_neg = (b.T @ sigmoid(zb)) / len(b) - prior * (a.T @ sigmoid(za)) / len(a)
            negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
            grad = prior * grad_pos + grad_neg if negative >= 0 else -grad_neg
            adam.step(w, grad + DECAY * w)
        if epoch >= EPOCHS // 2:
            mean_w, taken = mean_w + w, taken + 1
    return mean, scale, mean_w / max(1, taken)


def train(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """The model, fitted on the driver from features of the sampled documents."""
    learn = labels.filter((remainder(id, MOD) != HELD_OUT) & F.col(label).isNotNull())
    parts = []
    for k, (rows, n) in enumerate(((learn.filter(F.col(label) == 1), POSITIVES), (learn.filter(F.col(label) == 0), NEGATIVES), (df.filter(remainder(id, MOD) != HELD_OUT), UNLABELLED))):
        parts.append(first_by_hash(rows, id, n, k).withColumn("pu_set", F.lit(k)))
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])  # bounded by the three sizes

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py() or "").tobytes() for t in batch.column(1)], pa.binary())], names=["pu_set", "pu_x"])

    got = df.select(id, text).join(F.broadcast(chosen), id).select("pu_set", text).mapInArrow(run, "pu_set int, pu_x binary").toArrow()
    sets, width = got.column(0).to_numpy(), len(features(""))
    x = np.frombuffer(b"".join(v.as_py() for v in got.column(1)), np.float32).reshape(-1, width)
    x = x[np.lexsort([*x.T[:8], sets])] if len(x) else x  # the order of rows must not matter
    sets = np.sort(sets)
    n1, n0 = (sets == 0).sum(), (sets == 1).sum()
    counts = {r[label]: r["count"] for r in learn.groupBy(label).count().collect()}
    prior = (counts.get(1, 0) + 1) / (counts.get(1, 0) + counts.get(0, 0) + 2)
    if not n1 or not n0 or not (sets == 2).any():
        return {"prior": prior}
    # One positive in CALIBRATE is left out of the risk; the scale is fitted on those and on the negatives, which are never in it.
    out = np.zeros(len(x), bool)
    out[np.flatnonzero(sets == 0)[::CALIBRATE]] = True
    mean, scale, w = fit(x[(sets == 0) & ~out] if n1 > 1 else x[sets == 0], x[sets == 2], prior)
    chosen = out | (sets == 1)
    z = np.clip((x[chosen] - mean) / scale, -8, 8) @ w[:-1] + w[-1]
    y = (sets[chosen] == 0).astype(float)
    # The samples' shares of labels are not the rows' own: the scale is fitted as sampled and moved by the odds.
    a, b = platt(z, y)
    b += np.log(prior / (1 - prior)) - np.log(y.sum() / n0)
    return {"prior": prior, "mean": mean, "scale": scale, "w": w, "a": a, "b": b}


def scorer(model: dict):
    def f(text: str) -> float:
        if "w" not in model:
            return float(model["prior"])
        z = np.clip((features(text) - model["mean"]) / model["scale"], -8, 8) @ model["w"][:-1] + model["w"][-1]
        return float(sigmoid(np.float64(model["a"] * z + model["b"])))

    return f


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, "doc_id", "text", remainder("doc_id", MOD) == HELD_OUT, THRESHOLD, lambda: scorer(model))


QUERIES = {"op5_pu_quality": op5_pu_quality}
ORACLES: dict[str, str] = {}
