"""Epoch training: gradients, saving every epoch, going on after a loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrad.operators import epochs


def rows_of(spark, n=96, batch=16):
    rng = np.random.default_rng(1)
    data = []
    for i in range(n):
        c = i % 3
        data.append((i // batch, c, [float(c == k) + 0.1 * float(rng.random()) for k in range(3)] + [1.0]))
    return epochs.in_batch_order(spark.createDataFrame(data, "batch_id long, target int, x array<double>").repartition(5))


def test_slope_is_the_derivative_of_the_loss():
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=(7, 16)), rng.integers(0, 16, 7)
    loss, slope = epochs.loss_and_slope(z, y)
    for k in range(16):
        d = np.zeros_like(z)
        d[:, k] = 1e-6
        assert np.allclose((epochs.loss_and_slope(z + d, y)[0] - epochs.loss_and_slope(z - d, y)[0]) / 2e-6, slope[:, k], atol=1e-8)
    assert (loss >= np.log((np.e + 15) / np.e) - 1e-12).all()      # the floor of the doubled softmax


def test_learns_and_saves_every_epoch(spark, tmp_dir):
    rows = rows_of(spark)
    log = epochs.train(rows, tmp_dir, 3, 0.3, accumulate=2, n_classes=3).orderBy("epoch").collect()
    assert [r.epoch for r in log] == [1, 2, 3] and all(r.steps == 3 for r in log)
    assert log[0].loss > log[1].loss > log[2].loss and all(abs(np.exp(r.loss) - r.perplexity) < 1e-9 for r in log)
    assert [epochs.load(spark, tmp_dir, e).steps for e in (1, 2, 3)] == [3, 6, 9]
    scored = epochs.score(rows.select(F.col("target").alias("gold"), "x"), epochs.load(spark, tmp_dir, 3), ("gold",)).collect()
    assert sum(int(np.argmax(r.p)) == r.gold for r in scored) == len(scored)


def test_goes_on_after_a_loss(spark, tmp_dir):
    rows = rows_of(spark)
    whole = epochs.train(rows, f"{tmp_dir}/a", 3, 0.1, accumulate=4, n_classes=3).orderBy("epoch").collect()
    epochs.train(rows, f"{tmp_dir}/b", 1, 0.1, accumulate=4, n_classes=3)
    # the second epoch was saved, but not logged: it is trained again
    epochs.save(spark, epochs.State(*(np.ones((3, 4)) for _ in range(3)), steps=99), f"{tmp_dir}/b", 2)
    again = epochs.train(rows, f"{tmp_dir}/b", 3, 0.1, accumulate=4, n_classes=3).orderBy("epoch").collect()
    assert np.allclose([r.loss for r in whole], [r.loss for r in again], atol=1e-12)
    a, b = (epochs.load(spark, f"{tmp_dir}/{k}", 3) for k in "ab")
    assert np.allclose(a.weights, b.weights, atol=1e-12) and a.steps == b.steps == 6


def test_texts_without_tokens_have_the_constant(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "i int, model_input string")
    x = {r.i: r.x for r in df.select("i", epochs.token_shares().alias("x")).collect()}
    assert sum(x[1]) == pytest.approx(2) and sum(x[2]) == sum(x[3]) == x[3][-1] == 1


def test_no_batch_is_an_error(spark, tmp_dir):
    with pytest.raises(ValueError):
        epochs.train(rows_of(spark).limit(0), tmp_dir, 1, 0.1, 1)
