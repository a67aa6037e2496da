"""Deep trees without a pass over all rows for each level."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hirelake.operators import forest, models
from hirelake.session import settle


def _rows(spark, n):
    """Dense and sparse vectors with negative, many-valued, rare and constant features; labels with mean zero."""
    rnd, rows = random.Random(3), []
    for i in range(n):
        x = [float(rnd.randint(-3, 3)), rnd.randint(0, 60) / 8, float(rnd.random() < 0.3), float(rnd.random() < 0.02), 0.0]
        y = float(8 * x[0] + 9 * (x[1] > 3) + 5 * x[2] * x[0] + rnd.randint(0, 50))
        held = [j for j in range(5) if x[j]]
        rows += [(sign * y, Vectors.dense(x) if i % 2 else Vectors.sparse(5, held, [x[j] for j in held])) for sign in (1, -1) if i % 5 or sign > 0]
    rows += [(-sum(y for y, _ in rows), Vectors.dense([0.0] * 5))]
    return settle(spark.createDataFrame(rows, ["label", "salary_features"]).repartition(3), "rows")


def _shape(stages):
    return [tree.toDebugString.split("\n")[1:] for stage in stages if hasattr(stage, "trees") for tree in stage.trees]


def test_trees_do_not_depend_on_the_rows_brought_together(spark, monkeypatch):
    df = _rows(spark, 300)
    passes = []
    plain = forest._split_large
    monkeypatch.setattr(forest, "_split_large", lambda *a: (passes.append(a), plain(*a))[1])
    whole = _shape(models.fit_forest(df, 3, 30, 7, at_once=2))
    assert not passes and len(whole) == 3
    assert _shape(models.fit_forest(df, 3, 30, 7, at_once=2, most=100)) == whole and passes
    assert _shape(models.fit_forest(df, 3, 30, 7, at_once=3, most=10**6)) == whole
    assert max(len(tree) for tree in whole) > 100


def test_a_fully_grown_tree_gives_the_mean_of_equal_rows(spark):
    rnd = random.Random(5)
    rows = [(rnd.random() * 1e5, Vectors.dense([float(rnd.randint(0, 5)), float(rnd.randint(-2, 2)), float(rnd.random() < 0.4)])) for _ in range(400)]
    df = settle(spark.createDataFrame(rows, ["label", "salary_features"]).coalesce(1), "rows")
    (stage,) = models.fit_forest(df, 2, 30, 11)
    held = [(r["label"], r["salary_features"]) for r in df.withColumn("i", F.monotonically_increasing_id()).orderBy("i").collect()]
    for number, tree in enumerate(stage.trees):
        sample = forest.weights(np.arange(400), number, 11)
        assert abs(sample.mean() - 1) < 0.2 and sample.max() > 2
        for _, x in held[:40]:
            same = [(w, y) for w, (y, other) in zip(sample, held) if other == x and w]
            if same:
                assert tree.predict(x) == pytest.approx(sum(w * y for w, y in same) / sum(w for w, _ in same))


def test_depth_and_bins_are_kept_to(spark, monkeypatch):
    df = _rows(spark, 300)
    monkeypatch.setattr(models, "SHALLOW", 0)
    (stage,) = models.fit_forest(df, 2, 3, 7)
    assert [tree.depth for tree in stage.trees] == [3, 3]
    layout = forest.layout_of(df, "salary_features", 5)
    assert np.diff(layout.first).tolist() == [6, 31, 1, 1, 0]
    constant = df.withColumn("label", F.lit(4.0))
    (flat,) = models.fit_forest(constant, 2, 30, 7)
    assert flat.totalNumNodes == 2 and flat.trees[0].predict(Vectors.dense([0.0] * 5)) == 4.0


def test_spark_grows_shallow_trees_only(spark, monkeypatch):
    df, deep = _rows(spark, 60), []
    plain = forest.grow_trees
    monkeypatch.setattr(forest, "grow_trees", lambda *a: (deep.append(a[2]), plain(*a))[1])
    for depth in (models.SHALLOW, models.SHALLOW + 1):
        (stage,) = models.fit_forest(df, 2, depth, 7)
        assert stage.getNumTrees == 2 and stage.getMaxDepth() == depth
    assert deep == [models.SHALLOW + 1]


def test_runs_of_equal_weight_stand_for_many_values():
    rnd = np.random.default_rng(2)
    value = rnd.permutation(np.arange(50_000.0))
    feature = np.concatenate([np.zeros(50_000, dtype=np.int64), np.ones(3, dtype=np.int64)])
    f, v, n = forest._merged(feature, np.concatenate([value, [1.0, 2.0, 2.0]]), np.ones(50_003, dtype=np.int64), 1000)
    assert (f == 0).sum() <= 1000 and n.sum() == 50_003 and v[f == 1].tolist() == [1.0, 2.0] and n[f == 1].tolist() == [1, 2]
    bounds = forest._bounds(v[f == 0], n[f == 0])
    assert len(bounds) == 31 and np.allclose(bounds, 50_000 * np.arange(1, 32) / 32, atol=200)
