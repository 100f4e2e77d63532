"""Softmax regression by full-batch steps on exact sums (M1, M2, M5).

Several heads (a label column and its number of classes each) share a row's
features ``x``: the 16-way task is one head, the four letters are four, fitted
in the same passes. A step is one Spark job over the training rows. Every row's
gradient and loss are rounded to whole numbers of 2**-SCALE_BITS before they
are added - in a task as 64-bit integers, over the tasks as decimals - so a
step's sums do not depend on how rows are dealt, on the order of tasks, or on
which of them ran twice: a fit repeats to the last bit on any cluster.

What reaches the driver per step is one number per (class, feature) and two
per head. Rows without a label of a head do not count for that head.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE_BITS = 30
#: rows whose gradients a task holds at once
SLICE = 1024


@dataclass
class Softmax:
    """Weights (classes of all heads x features) and a log row per step and head."""
    heads: list[tuple[str, int]]
    weights: np.ndarray
    log: list[tuple[int, str, int, float]]

    def spans(self) -> list[tuple[str, slice]]:
        ends = np.cumsum([n for _, n in self.heads]).tolist()
        return [(name, slice(e - n, e)) for (name, n), e in zip(self.heads, ends)]


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def row_sums(x: np.ndarray, labels: dict[str, np.ndarray], model: Softmax) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number sums over rows: gradient (classes, features), and per head
    (loss, rows). A label below 0 is none."""
    grad = np.zeros(model.weights.shape, np.int64)
    totals = np.zeros((len(model.heads), 2), np.int64)
    one = float(1 << SCALE_BITS)
    z = x @ model.weights.T
    for h, (name, span) in enumerate(model.spans()):
        own = np.flatnonzero(labels[name] >= 0)
        y, p = labels[name][own], probabilities(z[own, span])
        at = np.arange(len(own))
        totals[h] = np.rint(-np.log(np.maximum(p[at, y], 1e-300)) * one).astype(np.int64).sum(), len(own)
        p[at, y] -= 1
        grad[span] = np.rint(p[:, :, None] * x[own][:, None, :] * one).astype(np.int64).sum(0)
    return grad, totals


def _step_sums(rows: DataFrame, model: Softmax) -> tuple[np.ndarray, np.ndarray]:
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [n for n, _ in model.heads]

    def run(batches):
        m = held.value
        total = np.zeros(m.weights.size + 2 * len(m.heads), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                labels = {n: part.column(n).fill_null(-1).to_numpy() for n in names}
                grad, ends = row_sums(x, labels, m)
                total += np.append(grad.ravel(), ends.ravel())
        yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

    sums = rows.select("x", *names).mapInArrow(run, "i int, v long").groupBy("i") \
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros(model.weights.size + 2 * len(names))
    for r in sums:
        out[r.i] = float(r.v)
    grad, ends = out[:model.weights.size].reshape(model.weights.shape), out[model.weights.size:].reshape(-1, 2)
    return grad / (1 << SCALE_BITS), ends / [1 << SCALE_BITS, 1]


def fit(rows: DataFrame, heads: list[tuple[str, int]], steps: int, rate: float, penalty: float = 0.0) -> Softmax:
    """Gradient descent from zero weights on the mean cross-entropy plus
    ``penalty`` / 2 times the squared weights. ``rows``: ``x`` (doubles, all of
    one length, none null) and an int column per head. The log has
    (step, head, rows, mean loss before the step)."""
    first = rows.select("x").first()
    if first is None:
        raise ValueError("no row to fit on")
    model = Softmax(list(heads), np.zeros((sum(n for _, n in heads), len(first.x))), [])
    for step in range(1, steps + 1):
        grad, ends = _step_sums(rows, model)
        for (name, span), (loss, n) in zip(model.spans(), ends):
            if not n:
                raise ValueError(f"no label in {name}")
            model.log.append((step, name, int(n), float(loss / n)))
            model.weights[span] -= rate * (grad[span] / n + penalty * model.weights[span])
    return model


def score(rows: DataFrame, model: Softmax, keep: tuple = ("post_id", "gold")) -> DataFrame:
    """``(keep..., p_<head> ARRAY<DOUBLE> ...)``; the model is of a fixed size
    and goes to every task."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    kind = "struct<" + ", ".join(f"p_{n}: array<double>" for n, _ in model.heads) + ">"

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        m = held.value
        z = x.flatten().to_numpy().reshape(len(x), -1) @ m.weights.T if len(x) else np.zeros((0, len(m.weights)))
        out = []
        for _, span in m.spans():
            p = probabilities(z[:, span]) if len(x) else z[:, span]
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel())))
        return pa.StructArray.from_arrays(out, [f"p_{n}" for n, _ in m.heads])
    return rows.select(*keep, run("x").alias("_p")).select(*keep, "_p.*")
