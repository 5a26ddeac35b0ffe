"""Isolation forest (Liu, Ting, Zhou 2008): F6 train, F7 score and flag, B8 flagged rows.

Spark has no isolation forest, so this is the one operator with Python on
executors:

* every tree draws its own sample, by the same rule at every table size: a row
  joins a tree when hash(row key, tree, seed) falls below a share that gives
  somewhat more than psi rows, and the psi smallest hashes stay. Without a key,
  equal rows are counted first and each tree draws a hash-seeded binomial number
  of their copies, so repeated rows are sampled as often as they occur. Neither
  depends on partitioning, and no tree sees more than some 400 candidate rows;
* ``groupBy(tree).applyInPandas`` grows the trees, one group per tree
  (at most psi rows each); the node table has at most trees * (2 psi - 1)
  rows -- 51,100 for the defaults -- which is the proven bound that lets it be
  broadcast;
* scoring is a scalar pandas UDF over the feature columns only, which walks every
  tree for a whole Arrow batch; other columns stay in the JVM as they are;
* the offset is the exact ``contamination`` quantile of the training scores,
  computed by the distributed ``exact_quantiles``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import path_not_found, qcol
from ..session import materialize
from .ordered import exact_quantiles

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int, depth int")
EULER_GAMMA = 0.5772156649015329


def average_path_length(m: np.ndarray | float) -> np.ndarray:
    """c(m): mean path length of an unsuccessful search in a binary tree of m points."""
    m = np.asarray(m, dtype=float)
    out = np.zeros_like(m)
    two = m == 2
    big = m > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(m[big] - 1.0) + EULER_GAMMA) - 2.0 * (m[big] - 1.0) / m[big]
    return out


def _grow_trees(features: list[str], psi: int, seed: int):
    limit = max(1, int(math.ceil(math.log2(max(psi, 2)))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_h", kind="mergesort")
        X = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        rows: list[tuple] = []

        def grow(idx: np.ndarray, depth: int) -> int:
            nid = len(rows)
            rows.append(None)
            sub = X[idx]
            if depth >= limit or len(idx) <= 1:
                rows[nid] = (tree, nid, -1, float("nan"), -1, -1, len(idx), depth)
                return nid
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if cand.size == 0:
                rows[nid] = (tree, nid, -1, float("nan"), -1, -1, len(idx), depth)
                return nid
            q = int(rng.choice(cand))
            t = float(rng.uniform(lo[q], hi[q]))
            go_left = sub[:, q] < t
            left = grow(idx[go_left], depth + 1)
            right = grow(idx[~go_left], depth + 1)
            rows[nid] = (tree, nid, q, t, left, right, len(idx), depth)
            return nid

        grow(np.arange(len(X)), 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    return build


def _walk(nodes: dict, X: np.ndarray) -> np.ndarray:
    """Mean path length over all trees for each row of X (no missing values)."""
    feature, threshold = nodes["feature"], nodes["threshold"]
    left, right, size, depth, roots = nodes["left"], nodes["right"], nodes["size"], nodes["depth"], nodes["roots"]
    total = np.zeros(len(X))
    rows = np.arange(len(X))
    for root in roots:
        idx = np.full(len(X), root, dtype=np.int64)
        for _ in range(nodes["max_depth"] + 1):
            f = feature[idx]
            internal = f >= 0
            if not internal.any():
                break
            x = X[rows, np.where(internal, f, 0)]
            nxt = np.where(x < threshold[idx], left[idx], right[idx])
            idx = np.where(internal, nxt, idx)
        total += depth[idx] + average_path_length(size[idx])
    return total / len(roots)


def _node_arrays(node_pdf: pd.DataFrame) -> dict:
    """Flatten the node table to absolute indices for vectorised walking."""
    pdf = node_pdf.sort_values(["tree", "node"]).reset_index(drop=True)
    offsets = {}
    pos = 0
    for tree, count in pdf.groupby("tree", sort=True).size().items():
        offsets[tree] = pos
        pos += int(count)
    base = pdf["tree"].map(offsets).to_numpy()
    left = np.where(pdf["left"].to_numpy() >= 0, pdf["left"].to_numpy() + base, -1)
    right = np.where(pdf["right"].to_numpy() >= 0, pdf["right"].to_numpy() + base, -1)
    return {"feature": pdf["feature"].to_numpy(np.int64), "threshold": pdf["threshold"].to_numpy(float),
            "left": left.astype(np.int64), "right": right.astype(np.int64),
            "size": pdf["size"].to_numpy(float), "depth": pdf["depth"].to_numpy(float),
            "roots": np.array([offsets[t] for t in sorted(offsets)], dtype=np.int64),
            "max_depth": int(pdf["depth"].max()) if len(pdf) else 0}


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame
    features: list[str]
    psi: int
    offset: float
    contamination: float
    n_samples: int

    def raw_scores(self, df: DataFrame, out_col: str = "_raw") -> DataFrame:
        """-s(x) = -2^(-E[h(x)] / c(psi)); null when a feature is missing."""
        arrays = df.sparkSession.sparkContext.broadcast(_node_arrays(self.nodes))
        c_psi = float(average_path_length(np.array([self.psi]))[0]) or 1.0

        @F.pandas_udf(T.DoubleType())
        def walk(x: pd.DataFrame) -> pd.Series:
            X = x.to_numpy(dtype=float)
            ok = ~np.isnan(X).any(axis=1)
            raw = np.full(len(X), np.nan)
            if ok.any():
                raw[ok] = -np.power(2.0, -_walk(arrays.value, X[ok]) / c_psi)
            return pd.Series(raw)

        x = F.struct(*[qcol(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])
        return df.withColumn(out_col, F.nanvl(walk(x), F.lit(None).cast("double")))

    def score(self, df: DataFrame) -> DataFrame:
        """adds ``score`` (decision function; negative = anomalous) and
        ``is_fraud`` (score < 0; false when a feature is missing)."""
        missing_cols = [f for f in self.features if f not in df.columns]
        if missing_cols:
            raise ValueError(f"the table lacks the model's columns {missing_cols}")
        raw = self.raw_scores(df)
        s = F.col("_raw") - F.lit(self.offset)
        return raw.withColumn("score", s).withColumn("is_fraud", F.coalesce(s < 0, F.lit(False))).drop("_raw")

    def save(self, spark: SparkSession, path: str) -> str:
        """Node table as parquet plus the parameters as JSON."""
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        params = {"features": self.features, "psi": self.psi, "offset": self.offset,
                  "contamination": self.contamination, "n_samples": self.n_samples}
        spark.createDataFrame([(json.dumps(params),)], "params string").write.mode("overwrite").text(f"{path}/params")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel | None":
        try:
            nodes = spark.read.parquet(f"{path}/nodes").toPandas()
            params = json.loads(spark.read.text(f"{path}/params").first()[0])
        except Exception as e:  # noqa: BLE001 - only an absent path means "no model"
            if not path_not_found(e):
                raise
            return None
        return IsolationForestModel(nodes, params["features"], params["psi"], params["offset"],
                                    params["contamination"], params["n_samples"])


def _share(*parts):
    """A hash of ``parts`` as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _tree_samples(X: DataFrame, feats: list[str], n: int, n_trees: int, psi: int, seed: int, keyed: bool) -> DataFrame:
    """The rows of each tree: ``feats``, ``tree``, ``_h`` (order within the tree)."""
    share = min(1.0, (psi + 6 * math.sqrt(psi) + 8) / n)
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    cols = [qcol(c) for c in feats]

    def once(rows: DataFrame, keys: list) -> DataFrame:
        drawn = F.filter(trees, lambda t: _share(F.lit(seed), t, *keys) < share)
        return (rows.withColumn("tree", F.explode(drawn))
                .select(*cols, "tree", F.xxhash64(F.lit(seed + 1), "tree", *keys).alias("_h")))

    if keyed:
        drawn = once(X, [F.col("_key")])
    else:
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def copies(n_equal: pd.Series, key: pd.Series) -> pd.Series:
            return pd.Series([np.random.default_rng([seed, k & (2 ** 64 - 1)]).binomial(c, share, n_trees).astype(np.int32)
                              for c, k in zip(n_equal.tolist(), key.tolist())])

        groups = X.groupBy(*cols).agg(F.count("*").alias("_n"))
        many = (groups.where("_n > 1").withColumn("_c", copies(F.col("_n"), F.xxhash64(*cols)))
                .select(*cols, F.posexplode("_c").alias("tree", "_m")).where("_m > 0")
                .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_m")))
                .select(*cols, "tree", F.xxhash64(F.lit(seed + 1), "tree", "_copy", *cols).alias("_h")))
        drawn = once(groups.where("_n = 1"), cols).unionByName(many)
    first = F.row_number().over(Window.partitionBy("tree").orderBy("_h", *cols))
    return drawn.withColumn("_rn", first).where(F.col("_rn") <= psi).drop("_rn")


def fit_isolation_forest(df: DataFrame, features: list[str] | None = None, n_trees: int = 100,
                         contamination: float = 0.01, seed: int = 42, max_samples: int = 256,
                         key: str | None = None) -> IsolationForestModel:
    """drop rows with any missing value, then grow ``n_trees`` trees on
    ``min(max_samples, n)`` rows each. Contamination must be in (0, 0.5]. ``key`` names a
    row key to sample by (not a feature unless listed); without one, equal rows are counted."""
    if not (0 < contamination <= 0.5):
        raise ValueError("contamination must be in (0, 0.5]")
    data = df.dropna()
    feats = features or [c for c in data.columns if c != key]
    keyed = [F.xxhash64(qcol(key)).alias("_key")] if key else []
    X = data.select(*[qcol(c).cast("double").alias(c) for c in feats], *keyed)
    n = X.count()
    if n == 0:
        raise ValueError("no complete rows to train on")
    psi = min(max_samples, n)
    sample = _tree_samples(X, feats, n, n_trees, psi, seed, bool(key))
    nodes = sample.groupBy("tree").applyInPandas(_grow_trees(feats, psi, seed), NODE_SCHEMA).toPandas()
    model = IsolationForestModel(nodes, feats, psi, 0.0, contamination, n)
    # the training scores are read by two quantile passes: score once, keep only the score column
    raw = materialize(model.raw_scores(X).select("_raw"))
    q = exact_quantiles(raw, ["_raw"], [contamination]).first()
    model.offset = float(q["value"])
    return model


def flagged_rows(scored: DataFrame, n: int | None = None, order_by: str | None = None) -> DataFrame:
    """Rows flagged as anomalous, scores bound to their rows; the first
    ``n`` in row order when asked (a preview)."""
    out = scored.where(F.col("is_fraud"))
    if n is not None:
        out = (out.orderBy(order_by) if order_by else out).limit(n)
    return out
