"""Linear distillation: a conditional-logit student over per-candidate features, fitted to soft targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.functions import dist as D

# Fixed values of the optimiser.
BETA1, BETA2, EPS, DECAY, CLIP = 0.9, 0.999, 1e-8, 0.01, 1.0


def gradient_of(w: np.ndarray, x: np.ndarray, z: np.ndarray, size: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Items, loss, divergence and gradient summed over items whose candidates lie one after the other.

    ``x`` has a row per candidate, ``z`` the teacher's scores, ``size`` the candidates of each item, ``gold`` a position or
    -1. Sums within items are segment sums, so there is no loop over items.
    """
    t = D.KD_TEMPERATURE
    start, item = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)

    def softmax(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - np.maximum.reduceat(a, start)[item])
        return e / np.add.reduceat(e, start)[item]

    s = x @ w
    pt, ps, p = softmax(z / t), softmax(s / t), softmax(s)
    kl = np.add.reduceat(pt * (np.log(np.maximum(pt, 1e-300)) - np.log(np.maximum(ps, 1e-300))), start)
    loss, ds, has = t * t * kl, t * (ps - pt), gold >= 0
    hot = np.arange(len(item)) == (start + gold)[item]
    of_gold = np.log(np.maximum(p[np.where(has, start + gold, 0)], 1e-300))
    loss = np.where(has, D.W_KD_GOLD * loss - D.W_CE_GOLD * of_gold, loss)
    ds = np.where(has[item], D.W_KD_GOLD * ds + D.W_CE_GOLD * (p - hot), ds)
    return np.concatenate([[len(size), loss.sum(), kl.sum()], x.T @ ds])


def _gradient(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(len(w) + 3)
        for b in batches:
            some = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column(0)), 0))
            if some.num_rows:
                x = some.column(0).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w))
                size = pa.compute.list_value_length(some.column(0)).to_numpy(zero_copy_only=False)
                gold = some.column(2).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                acc += gradient_of(w, x, some.column(1).flatten().to_numpy(zero_copy_only=False), size, gold)
        yield pa.RecordBatch.from_arrays([pa.array([acc], pa.list_(pa.float64()))], names=["g"])

    return run


def fit(data: DataFrame, dims: int, steps: int, lr: float) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """AdamW on the whole set. Each step reads ``data`` (feats, t, gold) once; every task returns one short gradient row.

    ``data`` should be a written table: the same rows are read in every step.
    """
    w, m, v = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    history = []
    cols = F.posexplode("g").alias("i", "x")
    for step in range(1, steps + 1):
        parts = data.select("feats", "t", "gold").mapInArrow(_gradient(w), "g array<double>")
        rows = parts.select(cols).groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")  # dims + 3 numbers
        total = rows["x"].to_numpy()
        n, loss, kl, g = total[0], total[1] / total[0], total[2] / total[0], total[3:] / total[0]
        g = g * min(1.0, CLIP / max(np.linalg.norm(g), 1e-12))
        m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
        w = w * (1 - lr * DECAY) - lr * (m / (1 - BETA1 ** step)) / (np.sqrt(v / (1 - BETA2 ** step)) + EPS)
        history.append((step, float(loss), float(kl)))
    return w, history


def predict(data: DataFrame, w: np.ndarray) -> DataFrame:
    """Adds score array ``s``: one dot product per candidate; the weights travel inside the expression."""
    lit = "array(" + ", ".join(f"{float(x)!r}D" for x in w) + ")"
    return data.withColumn("s", F.expr(f"transform(feats, f -> {D.dot('f', lit)})"))
