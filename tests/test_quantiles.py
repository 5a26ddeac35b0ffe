"""Exact quantiles by selection: every size one way, against numpy; what is shuffled."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepark.operators.ordered import exact_quantiles
from prepark.operators.profile import describe
from paths import SF01

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_against_numpy(spark, parts):
    rng = np.random.default_rng(1)
    n = 5000
    cols = {"smooth": rng.normal(size=n), "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 4.0),
            "heavy": np.where(rng.random(n) < 0.6, 7.0, rng.random(n)), "zeros": np.where(rng.random(n) < 0.5, 0.0, -0.0),
            "far": np.concatenate([[np.inf, -np.inf] * 30, rng.normal(size=n - 60)])}
    rows = [tuple(float(v) for v in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(parts)
    df = df.withColumn("gaps", F.when(F.col("few") > 0, F.col("smooth")).otherwise(F.lit(float("nan")))).withColumn("none", F.lit(None).cast("double"))
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, [*cols, "gaps", "none"], PROBS).collect()}
    cols["gaps"] = cols["smooth"][cols["few"] > 0]
    want = {(c, p): float(np.quantile(np.sort(v), p, method="lower") if c == "far" else np.quantile(v, p)) for c, v in cols.items() for p in PROBS}
    for key, value in want.items():
        if key[0] == "far" and abs(value) != np.inf:
            continue  # numpy's interpolation between infinities differs; ends are compared
        assert got[key] == pytest.approx(value, abs=1e-12), key
    assert not [k for k in got if k[0] == "none"]


def test_small_tables(spark):
    for values in ([1.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], PROBS).collect()}
        assert got == {p: pytest.approx(np.quantile(values, p)) for p in PROBS}
    assert exact_quantiles(df.limit(0), ["x"], PROBS).count() == 0


def test_describe_shuffles_few_cells(spark):
    """The blocks that hold a wanted rank are a small share of the cells."""
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_extendedprice", "l_orderkey", "l_partkey")
    n = li.count()
    out = describe(li)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    assert "kll" not in plan.toString() and "SortAggregate" not in plan.toString()
    q = exact_quantiles(li, li.columns, [0.25, 0.5, 0.75])
    q.collect()
    stack, made = [q._jdf.queryExecution().executedPlan()], []
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            made.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    assert made and max(made) < 0.05 * 3 * n
