"""Random forest by cells (F8, F9): MLlib's rules, any partitioning, nothing of the trees on the driver."""

import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from prepark.operators import forest as FO
from prepark.operators import models as ML
from prepark.session import write_scratch
from prepark.streaming import streams as J


def made(spark, n=600):
    """Numbers with repeats and ties; the class follows them with noise."""
    r = spark.range(n).select("id", (F.col("id") * 37 % 101 / 3.0).alias("a"), F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") * 53 % 97 / 7.0).alias("b"),
                              (F.col("id") * 11 % 5).alias("c"))
    return r.withColumn("target", ((F.col("a") > 15) != (F.col("id") * 29 % 13 < 3)).cast("int"))


def risks(model, df):
    return np.array([r["risk"] for r in ML.predict(model, df).orderBy("id").select("risk").collect()])


def test_trees_are_a_table_and_do_not_depend_on_partitions(spark):
    df, feats = made(spark, 400), ["a", "b", "c"]
    models = [ML.train_forest(df.repartition(n), "target", feats, num_trees=12) for n in (1, 7)]
    assert [m.trees.count() for m in models] == [12, 12]
    one, seven = (sorted(map(tuple, m.trees.collect())) for m in models)
    assert one == seven and models[0].edges == models[1].edges
    assert (risks(models[0], df) == risks(models[1], df.repartition(5))).all()


def test_forest_is_as_near_to_mllib_as_mllib_with_another_seed(spark):
    df, feats = made(spark), ["a", "b", "c"]
    data = df.select(*[F.col(c).cast("double") for c in feats], F.col("target").cast("double").alias("label"))
    cells = ML.train_forest(df, "target", feats, num_trees=60)
    mllib, other = (ML._mllib_forest(data, feats, 60, 30, seed) for seed in (42, 7))
    at = [set() for _ in feats]
    for f, x in re.findall(r"feature (\d+) <= (\S+?)\)", mllib.stages[1].toDebugString):
        at[int(f)].add(float(x))
    assert all(seen <= set(mine) for seen, mine in zip(at, cells.edges, strict=True)) and [len(e) for e in cells.edges][2] == 4
    a, b, c = risks(cells, df), risks(mllib, df), risks(other, df)
    assert np.abs(a - b).mean() < 1.3 * np.abs(c - b).mean() and abs(a.mean() - b.mean()) < 0.02


def test_as_many_cells_however_many_rows(spark, monkeypatch):
    df = made(spark, 300)
    once, often = (write_scratch(d.select(*[F.col(c).cast("double") for c in "abc"], F.col("target").cast("double").alias("label")), "rows")
                   for d in (df, df.crossJoin(spark.range(30).select(F.lit(1).alias("_x"))).drop("_x")))
    got, written = [], FO.write_scratch
    monkeypatch.setattr(FO, "write_scratch", lambda d, name: got.append((name, d)) or written(d, name))
    for rows in (once, often):
        FO.fit_forest(rows, ["a", "b", "c"], 2, 3, 42)
    cells = [(d.count(), d.agg(F.sum("n")).first()[0]) for name, d in got if name == "forest-cells"]
    assert cells[1] == (cells[0][0], 30 * cells[0][1]) and cells[0][1] == 300


def test_thresholds_of_many_rows_come_from_about_10000(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).cast("double").alias("x"), F.lit(1.0).alias("same"))
    edges, again = (FO._edges(rows.repartition(n), ["x", "same"], 60_000, 42) for n in (2, 9))
    assert edges == again and edges[1] == [] and 29 <= len(edges[0]) <= 31
    assert all(abs(e - 625 * (k + 1)) < 500 for k, e in enumerate(edges[0]))
    often = rows.select(F.when(F.col("x") >= 10_000, F.col("x")).otherwise(0.0).alias("x"))  # half of the rows are equal
    edges = FO._edges(often, ["x"], 60_000, 42)[0]
    assert 29 <= len(edges) <= 31 and edges[0] >= 5_000 and abs(edges[-1] - 20_000 * 31 / 32) < 500


def test_grown_tree_counts_the_items_that_reach_a_leaf():
    rng = np.random.default_rng(5)
    bins, label, weight = rng.integers(0, 6, (3, 400), dtype=np.uint8), rng.integers(0, 3, 400), rng.poisson(1, 400)
    trees = []
    for most in (FO._NODES, 4):  # all open nodes at once, and in blocks
        FO._NODES, kept = most, FO._NODES
        try:
            trees.append(FO.grow_tree(bins, label, weight, 3, 30, np.random.default_rng(1)))
        finally:
            FO._NODES = kept
    for x, y in zip(*trees, strict=True):
        assert (x == y).all()
    feature, split, left, counts = trees[0]
    at = np.zeros(400, int)
    while (inner := feature[at] >= 0).any():
        i = at[inner]
        at[inner] = left[i] + (bins[feature[i], np.flatnonzero(inner)] > split[i])
    reached = np.zeros_like(counts)
    np.add.at(reached, (at, label), weight)
    assert (reached[feature < 0] == counts[feature < 0]).all() and (feature >= 0).sum() > 20
    inner = feature >= 0
    assert (counts[inner] == counts[left[inner]] + counts[left[inner] + 1]).all()
    low, high = left[inner], left[inner] + 1
    pair = (feature[low] < 0) & (feature[high] < 0)
    assert (counts[low].argmax(1) != counts[high].argmax(1))[pair].all()


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(9)
    bins, label, weight = rng.integers(0, 8, (2, 200), dtype=np.uint8), rng.integers(0, 2, 200), np.ones(200, int)
    feature, split, _, _ = FO.grow_tree(bins, label, weight, 2, 1, rng)

    def gini(y):
        return 1 - sum(np.mean(y == c) ** 2 for c in (0, 1)) if len(y) else 0.0

    def loss(f, s):
        low = bins[f] <= s
        return (low.sum() * gini(label[low]) + (~low).sum() * gini(label[~low])) / 200

    if feature[0] >= 0:  # leaves that predict the same are merged
        assert loss(feature[0], split[0]) <= min(loss(f, s) for f in (0, 1) for s in range(7)) + 1e-12


def test_missing_features_classes_and_many_features(spark):
    df = made(spark, 200).withColumn("target", F.col("id") % 3)
    model = ML.train_forest(df.withColumn("a", F.when(F.col("id") % 10 != 4, F.col("a"))), "target", ["a", "b", "c"], num_trees=5)
    gaps = df.withColumn("a", F.when(F.col("id") % 10 == 3, float("nan")).when(F.col("id") % 10 != 4, F.col("a"))).withColumn("kept", F.lit("x"))
    got = ML.predict(model, gaps)
    assert got.columns == [*gaps.columns, "prediction", "risk"]
    rows = got.collect()
    assert len(rows) == 200 and all((r["risk"] is None) == (r["prediction"] is None) == (r["id"] % 10 in (3, 4)) for r in rows)
    assert {r["prediction"] for r in rows} <= {None, 0.0, 1.0, 2.0} and model.n_classes == 3
    wide = df.select("id", (F.col("id") % 2).alias("target"), *[(F.col("id") * (j + 3) % 17).alias(f"f{j}") for j in range(14)])
    model = ML.train_forest(wide, "target", [f"f{j}" for j in range(14)], num_trees=5)
    assert np.abs(risks(model, wide) - np.array([i % 2 for i in range(200)])).mean() < 0.5
    same = ML.train_forest(df.withColumn("target", F.lit(0)), "target", ["a"], num_trees=3)
    assert set(risks(same, df)) == {0.0}
    for bad in (df.where("id < 0"), df.withColumn("target", F.lit(0.5)), df.withColumn("target", F.lit(-1))):
        with pytest.raises(ValueError):
            ML.train_forest(bad, "target", ["a"])


def test_forest_saved_loaded_and_on_a_stream(spark, tmp_path):
    df, path = made(spark, 200), str(tmp_path / "model")
    model = ML.train_forest(df, "target", ["a", "b", "c"], num_trees=5)
    ML.save_model(ML.train_logistic(df, key="id")[0], path)
    again = ML.load_model(ML.save_model(model, path))
    assert isinstance(again, FO.ForestModel) and again.edges == model.edges
    assert ML.save_model(again, path) == path and ML.load_model(path).trees.count() == 5
    want = risks(model, df)
    assert (risks(again, df) == want).all()
    df.repartition(3).withColumn("a", F.when(F.col("id") != 7, F.col("a"))).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    J.run_to_table(J.score_stream(s, again), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [r["risk"] for r in rows] == [None if i == 7 else x for i, x in enumerate(want)]
    ML.save_model(ML.train_logistic(df, key="id")[0], path)
    assert isinstance(ML.load_model(path), PipelineModel)


def test_more_cells_than_a_task_holds_are_left_to_mllib(spark, monkeypatch):
    monkeypatch.setattr(FO, "MAX_CELLS", 20)
    df = made(spark, 200)
    model = ML.train_forest(df, "target", ["a", "b"], num_trees=3, max_depth=4)
    assert isinstance(model, PipelineModel) and len(risks(model, df)) == 200
