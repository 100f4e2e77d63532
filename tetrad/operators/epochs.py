"""Epoch training of a softmax classifier.

The loop of the reference on Spark: batches in the stored order, the loss of a
batch as the mean of its rows, gradients accumulated over ``accumulate``
batches, then an Adam step; after an epoch the rate decays, loss and perplexity
are logged and the model is saved. What is fitted is a linear layer on hashed
token shares instead of a transformer; its output is softmax probabilities, and
the loss applies softmax once more, as the reference's does.

A step is one Spark job over the rows of its batches: every task adds up its
rows' gradients, the sums are added by place, and a fixed number of places
(classes x features) reaches the driver, which holds the model. Rows are written
once in batch order, so a step's filter reads its own files and row groups.

Every epoch has a folder of its own with the model, the moments and the log.
Training goes on after the last whole epoch found there, with the same result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.functions import text as T
from tetrad.session import materialize

FEATURES = 32            # hashed token shares; a constant comes after them
# --- fixed values: the optimizer's settings, and the decay of the rate per epoch
BETAS, EPSILON, GAMMA = (0.9, 0.999), 1e-8, 0.85


def token_shares(text_col: str = "model_input"):
    """Shares of the text's basic tokens by hash (first byte of the MD5), then a
    constant; a text without tokens has the constant only."""
    byte = F.transform(T.basic_tokens(text_col), lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int"))

    @F.arrow_udf("array<double>")
    def shares(rows: pa.Array) -> pa.Array:
        size = np.diff(rows.offsets.to_numpy()) if rows.null_count == 0 else np.array([len(x or ()) for x in rows.to_pylist()])
        row = np.repeat(np.arange(len(rows)), size)
        places = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64) % FEATURES
        x = np.bincount(row * FEATURES + places, minlength=len(rows) * FEATURES).reshape(len(rows), FEATURES).astype(float)
        x /= np.maximum(size, 1)[:, None]
        x = np.hstack([x, np.ones((len(rows), 1))])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES + 1), pa.int32()), pa.array(x.ravel()))
    return shares(F.coalesce(byte, F.array().cast("array<int>")))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss_and_slope(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of softmax(softmax(z)), and its derivative by z."""
    p = softmax(z)
    q = softmax(p)
    rows = np.arange(len(z))
    loss = np.log(np.exp(p).sum(1)) - p[rows, target]
    q[rows, target] -= 1
    return loss, p * (q - (q * p).sum(1, keepdims=True))


@dataclass
class State:
    """The model and the optimizer: weights, both moments, steps done."""
    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: int = 0

    def step(self, gradient: np.ndarray, rate: float) -> None:
        a, b = BETAS
        self.steps += 1
        self.mean = a * self.mean + (1 - a) * gradient
        self.square = b * self.square + (1 - b) * gradient * gradient
        self.weights = self.weights - rate * (self.mean / (1 - a ** self.steps)) / (
            np.sqrt(self.square / (1 - b ** self.steps)) + EPSILON)


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sums over rows of (target, x): the gradient, the loss, and the rows."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    places = weights.size

    def run(batches):
        total = np.zeros(places + 2)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            loss, slope = loss_and_slope(x @ held.value.T, b.column("target").to_numpy())
            total += np.append((slope.T @ x).ravel(), [loss.sum(), b.num_rows])
        yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

    out = np.zeros(places + 2)
    for r in rows.select("target", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out[:places].reshape(weights.shape), float(out[places]), int(round(out[places + 1]))


def epoch_path(path: str, epoch: int) -> str:
    return f"{path.rstrip('/')}/epoch={epoch:05d}"


def _saved(spark: SparkSession, path: str) -> int:
    """The last epoch saved whole: its log is written last."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    epoch = 0
    while fs.exists(jpath(f"{epoch_path(path, epoch + 1)}/log/_SUCCESS")):
        epoch += 1
    return epoch


def save(spark: SparkSession, state: State, path: str, epoch: int) -> None:
    c, f = state.weights.shape
    rows = [(i // f, i % f, float(w), float(m), float(v), state.steps) for i, (w, m, v) in
            enumerate(zip(state.weights.ravel(), state.mean.ravel(), state.square.ravel()))]
    spark.createDataFrame(rows, "class int, feature int, weight double, mean double, square double, steps long") \
        .coalesce(1).write.mode("overwrite").parquet(f"{epoch_path(path, epoch)}/model")


def load(spark: SparkSession, path: str, epoch: int) -> State:
    """The model after an epoch."""
    t = spark.read.parquet(f"{epoch_path(path, epoch)}/model").orderBy("class", "feature").collect()
    shape = (max(r["class"] for r in t) + 1, max(r.feature for r in t) + 1)
    return State(*(np.array([r[k] for r in t]).reshape(shape) for k in ("weight", "mean", "square")), t[0].steps)


def in_batch_order(rows: DataFrame) -> DataFrame:
    """(batch_id, target, x) written in the order of the batches."""
    return materialize(rows.select(F.col("batch_id").cast("long"), F.col("target").cast("int"), "x")
                       .repartitionByRange("batch_id").sortWithinPartitions("batch_id"), "train-rows")


def train(rows: DataFrame, path: str, epochs: int, rate: float, accumulate: int, gamma: float = GAMMA,
          n_classes: int = len(dims.CLASS_NAMES)) -> DataFrame:
    """Trains on ``rows`` of :func:`in_batch_order` (full batches of one size)
    and returns the log: epoch, loss, perplexity, steps, secs, ckpt_secs."""
    spark = rows.sparkSession
    head = rows.agg(F.max("batch_id").alias("last"), F.count(F.lit(1)).alias("n")).first()
    batches = 0 if head.last is None else head.last + 1
    if not batches:
        raise ValueError("no full batch to train on")
    size, width = head.n / batches, len(rows.first().x)
    done = _saved(spark, path)
    state = load(spark, path, done) if done else State(*(np.zeros((n_classes, width)) for _ in range(3)))
    for epoch in range(done + 1, epochs + 1):
        began, total, steps = time.perf_counter(), 0.0, 0
        for first in range(0, batches, accumulate):
            own = rows.where((F.col("batch_id") >= first) & (F.col("batch_id") < first + accumulate))
            slope, loss, _ = gradient(own, state.weights)
            state.step(slope / (size * accumulate), rate * gamma ** (epoch - 1))
            total, steps = total + loss / size, steps + 1
        mean, trained = total / batches, time.perf_counter()
        save(spark, state, path, epoch)
        log = [(epoch, mean, float(np.exp(mean)), steps, trained - began, time.perf_counter() - trained)]
        spark.createDataFrame(log, "epoch int, loss double, perplexity double, steps long, secs double, ckpt_secs double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{epoch_path(path, epoch)}/log")
    logs = [f"{epoch_path(path, e)}/log" for e in range(1, epochs + 1)]
    return spark.read.parquet(*logs)


def score(rows: DataFrame, state: State, keep: tuple = ("post_id", "gold")) -> DataFrame:
    """``(keep..., p ARRAY<DOUBLE>)`` of rows with features ``x``: one array
    expression a row over the model's fixed number of weights."""
    held = rows.sparkSession.sparkContext.broadcast(state.weights)

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        p = softmax(x.flatten().to_numpy().reshape(len(x), -1) @ held.value.T) if len(x) else np.zeros((0, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
    return rows.select(*keep, run("x").alias("p"))
