"""Full-batch softmax regression: gradients, exact sums, heads, labels that are missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrad.operators import softmaxfit as S


def rows_of(spark, n=300, parts=4, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, i % 3, i % 2, [float(i % 3 == k) + 0.3 * float(rng.random()) for k in range(3)] + [float(i % 2), 1.0]) for i in range(n)]
    return spark.createDataFrame(data, "id int, a int, b int, x array<double>").repartition(parts)


def plain(rows, heads, steps, rate, penalty):
    """The same descent in numpy, on all rows at once."""
    data = rows.collect()
    x = np.array([r.x for r in data])
    out, losses = [], []
    for name, n in heads:
        y, w = np.array([r[name] for r in data]), np.zeros((n, x.shape[1]))
        for _ in range(steps):
            p = S.probabilities(x @ w.T)
            losses.append(-np.log(p[np.arange(len(y)), y]).mean())
            p[np.arange(len(y)), y] -= 1
            w = w - rate * (p.T @ x / len(y) + penalty * w)
        out.append(w)
    return np.vstack(out), losses


def test_equals_the_plain_descent(spark):
    rows, heads = rows_of(spark), [("a", 3), ("b", 2)]
    model = S.fit(rows, heads, 5, 2.0, 0.01)
    weights, losses = plain(rows, heads, 5, 2.0, 0.01)
    assert np.allclose(model.weights, weights, atol=1e-7)
    assert np.allclose(sorted(r[3] for r in model.log), sorted(losses), atol=1e-7)
    assert [r[:3] for r in model.log] == [(s, h, 300) for s in range(1, 6) for h, _ in heads]
    for h, _ in heads:
        loss = [r[3] for r in model.log if r[1] == h]
        assert all(x > y for x, y in zip(loss, loss[1:]))


def test_sums_do_not_depend_on_the_partitions(spark):
    """Bit for bit, not nearly: one task, seven, and another order of rows."""
    rows = rows_of(spark)
    fits = [S.fit(r, [("a", 3)], 4, 2.0) for r in (rows.coalesce(1), rows.repartition(7), rows.orderBy(F.desc("id")))]
    assert all((f.weights == fits[0].weights).all() and f.log == fits[0].log for f in fits)


def test_heads_together_equal_heads_alone(spark):
    rows = rows_of(spark)
    both = S.fit(rows, [("a", 3), ("b", 2)], 3, 1.0)
    assert (both.weights[:3] == S.fit(rows, [("a", 3)], 3, 1.0).weights).all()
    assert (both.weights[3:] == S.fit(rows, [("b", 2)], 3, 1.0).weights).all()


def test_scores_learn(spark):
    rows = rows_of(spark)
    out = S.score(rows, S.fit(rows, [("a", 3), ("b", 2)], 20, 4.0), ("id", "a", "b")).collect()
    assert len(out) == 300 and all(abs(sum(r.p_a) - 1) < 1e-12 and len(r.p_b) == 2 for r in out)
    assert all(int(np.argmax(r.p_a)) == r.a and int(np.argmax(r.p_b)) == r.b for r in out)


def test_rows_without_a_label_do_not_count(spark):
    rows = rows_of(spark)
    more = rows.unionByName(rows.withColumn("a", F.lit(None).cast("int")))
    one, two = (S.fit(r, [("a", 3), ("b", 2)], 3, 1.0) for r in (rows, more))
    assert (one.weights[:3] == two.weights[:3]).all()
    assert {r[1]: r[2] for r in two.log} == {"a": 300, "b": 600}


def test_faults_and_empty_tables(spark):
    rows = rows_of(spark)
    with pytest.raises(ValueError):
        S.fit(rows.limit(0), [("a", 3)], 1, 1.0)
    with pytest.raises(ValueError):
        S.fit(rows.withColumn("a", F.lit(None).cast("int")), [("a", 3)], 1, 1.0)
    model = S.fit(rows, [("a", 3)], 1, 1.0)
    assert S.score(rows.limit(0), model, ("id",)).columns == ["id", "p_a"]
    assert S.score(rows.where("id < 0"), model, ("id",)).count() == 0


def test_far_scores_stay_finite():
    model = S.Softmax([("a", 2)], np.array([[1e4, 0.0], [-1e4, 0.0]]), [])
    grad, ends = S.row_sums(np.array([[1.0, 1.0]]), {"a": np.array([1])}, model)
    assert np.isfinite(ends).all() and grad[0, 0] == 1 << S.SCALE_BITS
