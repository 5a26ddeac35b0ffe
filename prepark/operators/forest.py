"""Random forest by cells (F8, F9): MLlib's trees without MLlib's driver.

MLlib sums up every open node of a level in every task and keeps all nodes of all trees as
objects on the driver (1.56 million for 40,083 rows). Here the same forest is grown from less:

* features are cut into at most 32 bins by MLlib's rule, from as many rows (to 10,000 rows the
  thresholds are MLlib's own). A tree can't tell rows apart that fall into the same bins, so rows
  are counted by *cell* (the bins of all features) and class: with d features at most 32^d
  cells, however many rows;
* a bootstrap by Poisson(1) per row is one by Poisson(n) per cell and class of n rows, so each tree
  draws its own weights in a task of its own, by numpy, level by level. Gini, features a node (square
  root of their number), depth and the merging of sibling leaves that predict the same are MLlib's;
* trees are rows of a table (packed arrays) that never passes through the driver. Scoring walks each
  distinct cell once and joins the votes back to the rows; votes are whole numbers, so their
  sums depend on no order. A stream is scored by its rows, with the trees broadcast.

Neither trees nor scores depend on partitioning. Random draws are not MLlib's.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import path_not_found, qcol
from ..session import materialize, write_scratch
from .iforest import _share

#: MLlib's bins a feature, and rows that it draws to find them
MAX_BINS, MAX_BINS_ROWS = 32, 10_000
#: equal rows that are numbered at once
_COPIES = 4096
#: bits a bin takes in a key, and bins a key holds
_BITS, _PER_KEY = 5, 12
#: counted cells that one task holds to grow a tree
MAX_CELLS = 1 << 21
#: open nodes whose bins are summed up at once
_NODES = 1 << 12
#: a leaf's vote for a class, in parts of a whole
_WHOLE = 1 << 40
#: bytes of trees that one task scores by
_TREE_BYTES = 1 << 24
#: gains below are rounding
_LEAST_GAIN = 1e-14

TREE_SCHEMA = "tree int, feature binary, split binary, left binary, counts binary"


def _keys(n_feats: int) -> list[str]:
    return [f"_cell{i}" for i in range(-(-n_feats // _PER_KEY))]


def _bin(x: Column, edges: list[float], low: int = 0) -> Column:
    """How many edges lie below x, by halving."""
    if not edges:
        return F.lit(low).cast("bigint")
    mid = len(edges) // 2
    return F.when(x <= F.lit(edges[mid]), _bin(x, edges[:mid], low)).otherwise(_bin(x, edges[mid + 1:], low + mid + 1))


def _cell(feats: list[str], edges: list[list[float]], good: Column | None = None) -> list[Column]:
    """The bins of all features packed into bigints; null where ``good`` is false."""
    out = []
    for i, name in enumerate(_keys(len(feats))):
        key = F.lit(0).cast("bigint")
        for j, c in enumerate(feats[i * _PER_KEY:(i + 1) * _PER_KEY]):
            key = key.bitwiseOR(F.shiftleft(_bin(qcol(c), edges[i * _PER_KEY + j]), _BITS * j))
        out.append((key if good is None else F.when(good, key)).alias(name))
    return out


def _unpacked(keys: list[np.ndarray], n_feats: int) -> np.ndarray:
    return np.stack([((keys[j // _PER_KEY] >> (_BITS * (j % _PER_KEY))) & (MAX_BINS - 1)).astype(np.uint8) for j in range(n_feats)])


def split_points(values: np.ndarray, counts: np.ndarray, n_splits: int) -> list[float]:
    """MLlib's thresholds for a feature from its sorted values and how often each occurs: between all
    values if they are few, else where the rows up to a value come closest to the next even step."""
    between = (values[:-1] + values[1:]) / 2
    if len(between) > n_splits:
        stride = counts.sum() / (n_splits + 1)
        upto, target, at = np.cumsum(counts), stride, []
        for i in range(len(between)):
            if abs(upto[i] - target) < abs(upto[i + 1] - target):
                at.append(i)
                target += stride
        between = between[at]
    return [float(x) for x in between]


def _edges(rows: DataFrame, feats: list[str], n: int, seed: int) -> list[list[float]]:
    """Thresholds of each feature from MLlib's number of rows (10,000, or all). A row is drawn by a hash of its
    values and of which one of the equal rows it is, so the draw doesn't depend on partitioning."""
    cols, share = [qcol(c) for c in feats], MAX_BINS_ROWS / n
    drawn = rows
    if share < 1:
        equal = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        # the leading 33 bits: sums that were added up in another order are drawn alike
        lead = [c * F.lit(2.0 ** 20 + 1) - (c * F.lit(2.0 ** 20 + 1) - c) for c in cols]
        step = F.lit(_COPIES).cast("bigint")
        drawn = (equal.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, step)))
                 .withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("_n")) - 1)))
                 .where(_share(F.lit(seed), "_copy", *lead) < share))
    values = (drawn.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), c.alias("value")) for i, c in enumerate(cols)])).alias("x"))
              .groupBy("x.feature", "x.value").agg(F.count(F.lit(1)).alias("n")))
    n_splits = min(MAX_BINS, n) - 1

    def split(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("value")
        return pd.DataFrame({"feature": x["feature"].iloc[:1].to_numpy(), "edges": [split_points(x["value"].to_numpy(), x["n"].to_numpy(), n_splits)]})

    found = {r["feature"]: list(r["edges"]) for r in values.groupBy("feature").applyInPandas(split, "feature int, edges array<double>").collect()}
    return [found.get(i, []) for i in range(len(feats))]


def grow_tree(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, n_classes: int, max_depth: int,
              rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree, level by level. ``bins``: features x items; an item weighs ``weight`` rows of class ``label``.

    Returns feature (-1: leaf), split (the last bin that goes left), left child (the right one
    follows it) and class counts of each node.
    """
    d, k = len(bins), n_classes
    chosen = int(np.ceil(np.sqrt(d)))
    width = int(bins.max(initial=0)) + 1
    some = weight > 0
    bins, label, weight = bins[:, some], label[some].astype(np.int64), weight[some].astype(np.float64)
    node = np.zeros(label.size, np.int64)
    counts = np.bincount(label, weight, k)[None, :]
    nodes = [(np.array([-1], np.int16), np.zeros(1, np.uint8), np.full(1, -1, np.int32), counts)]
    open_at = np.arange(1) if max_depth > 0 and np.count_nonzero(counts) > 1 else np.arange(0)
    n_nodes = 1
    for level in range(max_depth):
        n_open = open_at.size
        if not n_open:
            break
        feature, split, left, counts = nodes[-1]
        total = counts[open_at]
        picked = np.argsort(rng.random((n_open, d)), axis=1)[:, :chosen] if chosen < d else np.broadcast_to(np.arange(d), (n_open, d))
        if n_open > _NODES:  # items in the order of their nodes, so that a block of nodes is a slice
            order = np.argsort(node, kind="stable")
            bins, label, weight, node = bins[:, order], label[order], weight[order], node[order]
        best, best_f, best_s, best_left = np.full(n_open, _LEAST_GAIN), np.full(n_open, -1, np.int16), np.zeros(n_open, np.uint8), np.zeros((n_open, k))
        for a in range(0, n_open, _NODES):
            b = min(a + _NODES, n_open)
            part = slice(*np.searchsorted(node, [a, b])) if n_open > _NODES else slice(None)
            own, item_label, item_weight, rows = node[part] - a, label[part], weight[part], np.arange(node.size)[part]
            t = total[a:b].T[:, :, None]
            n = t.sum(0)
            before = (t * t).sum(0) / n
            for j in range(chosen):
                f = picked[a:b, j]
                at = (item_label * (b - a) + own) * width + bins[f[own], rows]
                lefts = np.bincount(at, item_weight, k * (b - a) * width).reshape(k, b - a, width).cumsum(2)[:, :, :-1]
                if not lefts.size:
                    continue
                rights = t - lefts
                n_left = lefts.sum(0)
                n_right = n - n_left
                valid = (n_left > 0) & (n_right > 0)
                after = (lefts * lefts).sum(0) / np.where(valid, n_left, 1) + (rights * rights).sum(0) / np.where(valid, n_right, 1)
                gain = np.where(valid, (after - before) / n, -1.0)
                s = gain.argmax(1)
                g = gain[np.arange(b - a), s]
                up = np.flatnonzero(g > best[a:b])
                best[a + up], best_f[a + up], best_s[a + up], best_left[a + up] = g[up], f[up], s[up], lefts[:, up, s[up]].T
        divided = best_f >= 0
        if not divided.any():
            break
        ids = open_at[divided]
        first = n_nodes + 2 * np.arange(ids.size)
        feature[ids], split[ids], left[ids] = best_f[divided], best_s[divided], first
        children = np.empty((2 * ids.size, k))
        children[0::2] = best_left[divided]
        children[1::2] = total[divided] - best_left[divided]
        nodes.append((np.full(len(children), -1, np.int16), np.zeros(len(children), np.uint8), np.full(len(children), -1, np.int32), children))
        n_nodes += len(children)
        is_open = (children > 0).sum(1) > 1 if level + 1 < max_depth else np.zeros(len(children), bool)
        open_at = np.flatnonzero(is_open)
        rank, slot = np.cumsum(divided) - 1, np.cumsum(is_open) - 1
        stay = divided[node]
        bins, label, weight, node = bins[:, stay], label[stay], weight[stay], node[stay]
        child = 2 * rank[node] + (bins[best_f[node], np.arange(node.size)] > best_s[node])
        stay = is_open[child]
        bins, label, weight, node = bins[:, stay], label[stay], weight[stay], slot[child[stay]]
    return _pruned(nodes)


def _pruned(levels: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sibling leaves that predict the same become one, from the deepest level up; nodes numbered anew."""
    starts = np.cumsum([0, *[len(x[0]) for x in levels]])
    feature, split, left, counts = (np.concatenate([x[i] for x in levels]) for i in range(4))
    says = counts.argmax(1)
    for a, b in reversed([*zip(starts[:-1], starts[1:], strict=True)]):
        ids = a + np.flatnonzero(feature[a:b] >= 0)
        low = left[ids]
        feature[ids[(feature[low] < 0) & (feature[low + 1] < 0) & (says[low] == says[low + 1])]] = -1
    there = np.zeros(len(feature), bool)
    there[0] = True
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ids = a + np.flatnonzero((feature[a:b] >= 0) & there[a:b])
        there[left[ids]] = there[left[ids] + 1] = True
    number = np.cumsum(there) - 1
    left = np.where(feature >= 0, number[left], -1).astype(np.int32)
    return feature[there], split[there], left[there], counts[there]


def _packed(tree: int, feature: np.ndarray, split: np.ndarray, left: np.ndarray, counts: np.ndarray) -> dict:
    """A row of the tree table; class counts only of the leaves, in their order."""
    return {"tree": tree, "feature": feature.astype("<i2").tobytes(), "split": split.tobytes(), "left": left.astype("<i4").tobytes(),
            "counts": counts[feature < 0].astype("<f8").tobytes()}


def _votes(row: dict, bins: np.ndarray, n_classes: int) -> np.ndarray:
    """Votes of one tree for each column of ``bins``, by class."""
    feature, split, left = np.frombuffer(row["feature"], "<i2"), np.frombuffer(row["split"], np.uint8), np.frombuffer(row["left"], "<i4")
    leaves = np.frombuffer(row["counts"], "<f8").reshape(-1, n_classes)
    at, going = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while going.size:
        i = at[going]
        f = feature[i]
        inner = f >= 0
        going, i, f = going[inner], i[inner], f[inner]
        at[going] = left[i] + (bins[f, going] > split[i])
    vote = np.rint(leaves / np.maximum(leaves.sum(1, keepdims=True), 1) * _WHOLE).astype(np.int64)
    return vote[(np.cumsum(feature < 0) - 1)[at]]


class ForestModel:
    """A fitted forest: the table of its trees, thresholds by feature, number of classes. The table
    of a model that was not saved is a scratch table (``session.cleanup`` deletes it)."""

    def __init__(self, trees: DataFrame, feature_names: list[str], edges: list[list[float]], n_classes: int, n_trees: int, path: str | None = None):
        self.trees, self.feature_names, self.edges, self.n_classes, self.n_trees, self.path = trees, feature_names, edges, n_classes, n_trees, path

    def scored(self, df: DataFrame, good: Column) -> DataFrame:
        """Adds ``prediction`` and ``risk`` (probability of class 1), null where not ``good``. The features are doubles."""
        return self._scored_stream(df, good) if df.isStreaming else self._scored_cells(df, good)

    def _scored_cells(self, df: DataFrame, good: Column) -> DataFrame:
        spark, d, k = df.sparkSession, len(self.feature_names), self.n_classes
        keys, votes = _keys(d), [f"_vote{i}" for i in range(k)]
        rows = materialize(df.select("*", *_cell(self.feature_names, self.edges, good)))  # read twice: for the cells and for the result
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        cells = rows.select(*keys).where(F.col(keys[0]).isNotNull()).distinct().repartition(tasks, F.xxhash64(*keys))

        def pack(batches):
            for x in batches:
                yield pa.RecordBatch.from_pylist([{"cells": np.stack([c.to_numpy() for c in x.columns]).astype("<i8").tobytes()}])

        def walk(batches):
            sums: dict[bytes, np.ndarray] = {}
            for x in batches:
                for i in range(x.num_rows):
                    row = {c: x.column(c)[i].as_buffer() for c in ("feature", "split", "left", "counts", "cells")}
                    own = np.frombuffer(cell := row["cells"].to_pybytes(), "<i8").reshape(len(keys), -1)
                    sums[cell] = sums.get(cell, 0) + _votes(row, _unpacked(own, d), k)
            for cell, sum_of in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*np.frombuffer(cell, "<i8").reshape(len(keys), -1), *sum_of.T]], [*keys, *votes])

        size = self.trees.agg(F.sum(sum((F.octet_length(c) for c in ("feature", "split", "left", "counts")), F.lit(0)))).first()[0]
        trees = self.trees.coalesce(-(-size // _TREE_BYTES))
        pairs = trees.crossJoin(cells.mapInArrow(pack, "cells binary").hint("shuffle_replicate_nl"))
        voted = (pairs.mapInArrow(walk, ", ".join(f"{c} bigint" for c in [*keys, *votes]))
                 .groupBy(*keys).agg(*[F.sum(v).alias(v) for v in votes]))
        most = F.greatest(*votes)
        total = F.greatest(sum((F.col(v) for v in votes), F.lit(0)), F.lit(1))  # 0: every tree drew no row
        scores = voted.select(*keys, (F.array_position(F.array(*votes), most) - 1).cast("double").alias("prediction"), (F.col(votes[1]) / total).alias("risk"))
        return rows.join(scores, on=keys, how="left").drop(*keys)

    def _scored_stream(self, df: DataFrame, good: Column) -> DataFrame:
        d, k = len(self.feature_names), self.n_classes
        trees = df.sparkSession.sparkContext.broadcast([{c: bytes(v) if c != "tree" else v for c, v in r.asDict().items()} for r in self.trees.collect()])

        @F.pandas_udf("prediction double, risk double")
        def walk(cells: pd.DataFrame) -> pd.DataFrame:
            distinct, where = np.unique(cells.to_numpy(np.int64), axis=0, return_inverse=True)
            bins, votes = _unpacked([*distinct.T], d), np.zeros((len(distinct), k), np.int64)
            for t in trees.value:
                votes += _votes(t, bins, k)
            votes = votes[where.reshape(-1)]
            return pd.DataFrame({"prediction": votes.argmax(1).astype(float), "risk": votes[:, 1] / np.maximum(votes.sum(1), 1)})

        got = walk(F.struct(*_cell(self.feature_names, self.edges)))
        out = df.withColumn("_score", got)
        return out.select(*[qcol(c) for c in df.columns], *[F.when(good, F.col(f"_score.{c}")).alias(c) for c in ("prediction", "risk")])

    def save(self, path: str) -> str:
        """The trees as parquet plus the parameters as JSON (overwrites)."""
        if path != self.path:
            spark = self.trees.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            params = {"features": self.feature_names, "edges": self.edges, "n_classes": self.n_classes, "n_trees": self.n_trees}
            self.trees.write.parquet(f"{path}/trees")
            spark.createDataFrame([(json.dumps(params),)], "params string").write.text(f"{path}/params")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel | None":
        try:
            params = json.loads(spark.read.text(f"{path}/params").first()[0])
        except Exception as e:  # noqa: BLE001 - only an absent path means "no model"
            if not path_not_found(e):
                raise
            return None
        return ForestModel(spark.read.parquet(f"{path}/trees"), params["features"], params["edges"], params["n_classes"], params["n_trees"], path)


def fit_forest(rows: DataFrame, feats: list[str], num_trees: int, max_depth: int, seed: int) -> ForestModel | None:
    """Grow a forest on ``rows`` (features and ``label``, all doubles, none missing), which are read several times.
    None if they have over ``MAX_CELLS`` counted cells, too many for a task."""
    spark, d, keys = rows.sparkSession, len(feats), _keys(len(feats))
    seen = rows.agg(F.count("label").alias("n"), F.max("label").alias("most"), F.max((F.col("label") < 0) | (F.col("label") != F.floor("label"))).alias("odd")).first()
    if seen["most"] is None:
        raise ValueError("no complete rows to learn from")
    if seen["odd"] or seen["most"] >= 100:
        raise ValueError("classes must be whole numbers from 0 to 99")
    k = max(2, int(seen["most"]) + 1)
    edges = _edges(rows, feats, seen["n"], seed)
    cells = write_scratch(rows.select("label", *_cell(feats, edges)).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")), "forest-cells")
    if cells.count() > MAX_CELLS:
        return None

    def pack(batches):
        x = [*batches]
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in x]).astype("<i8") for i in range(len(keys) + 2)] if x else [np.zeros(0, "<i8")] * (len(keys) + 2)
        order = np.lexsort(cols[-2::-1])  # the draws of a tree follow this order, whatever the partitions were
        yield pa.RecordBatch.from_pylist([{"cells": np.stack([c[order] for c in cols]).tobytes()}])

    def grow(batches):
        for x in batches:
            for tree, blob in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                cols = np.frombuffer(blob.as_buffer(), "<i8").reshape(len(keys) + 2, -1)
                rng = np.random.default_rng([seed, tree])
                got = grow_tree(_unpacked([*cols[:-2]], d), cols[-2], rng.poisson(cols[-1]), k, max_depth, rng)
                yield pa.RecordBatch.from_pylist([_packed(tree, *got)], schema=pa.schema([("tree", pa.int32()), *[(c, pa.binary()) for c in ("feature", "split", "left", "counts")]]))

    packed = write_scratch(cells.select(*keys, F.col("label").cast("bigint"), "n").coalesce(1).mapInArrow(pack, "cells binary"), "forest-packed")
    tasks = spark.range(0, num_trees, 1, num_trees).select(F.col("id").cast("int").alias("tree"))
    pairs = tasks.crossJoin(packed.coalesce(1).hint("shuffle_replicate_nl"))
    trees = write_scratch(pairs.mapInArrow(grow, TREE_SCHEMA), "forest-trees")
    return ForestModel(trees, feats, edges, k, num_trees)
