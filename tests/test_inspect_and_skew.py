"""The inspector's shared pass equals the separate operators; hot keys are split."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paths import SF01
from prepark.operators import clean as C
from prepark.operators import profile as P
from prepark.operators.ordered import assign_blocks
from prepark.plans.catalog import table
from prepark.plans.inspect import inspect


def test_inspect_matches_separate_operators(spark):
    labels = table(spark, SF01, "labels")
    got = inspect(labels, order_by="doc_id")
    sep = P.quick_summary(labels, P.field_roles(labels), order_by="doc_id")
    assert got["summary_text"] == sep["summary_text"]
    assert got["candidate_targets"] == sep["candidate_targets"] == ["quality", "toxic"]
    assert sorted(map(tuple, got["roles"].collect())) == sorted(map(tuple, P.field_roles(labels).collect()))
    assert [r["column"] for r in got["binary_targets"].collect()] == ["quality", "toxic"]
    assert got["pii"].count() == 0


def _hot_frame(spark, n=6000):
    rng = np.random.default_rng(7)
    user = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 200, n))  # user 0 holds a third of all rows
    val = rng.normal(size=n)
    val[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame({"i": np.arange(n), "user": user, "v": val})
    return pdf, spark.createDataFrame(pdf).select("i", "user", F.when(~F.isnan("v"), F.col("v")).alias("v"))


def test_hot_group_fill_matches_brute_force(spark):
    pdf, df = _hot_frame(spark)
    out = C.fill_forward_backward(df.repartition(7), ["v"], order_by="i", partition_by=["user"], n_blocks=16)
    got = out.toPandas().sort_values("i")["v"].to_numpy()
    exp = pdf.sort_values("i").groupby("user")["v"].transform(lambda s: s.ffill().bfill()).to_numpy()
    assert np.allclose(got, exp, equal_nan=True)


def test_hot_group_is_split_into_blocks(spark):
    _, df = _hot_frame(spark)
    blocked, names = assign_blocks(df, F.col("i"), n_blocks=16)
    per_block = blocked.where("user = 0").groupBy(*names).count().collect()
    assert len(per_block) >= 12
    assert max(r["count"] for r in per_block) <= 2 * 2000 / 16 * 1.5
