"""F1 deterministic split, F3 accuracy, F4 ROC AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import qcol
from .ordered import prefix_sums


def split_column(key: Column, test_fraction: float = 0.2, seed: int = 42, method: str = "hash") -> Column:
    """``'test'`` / ``'train'`` per row from its key alone, so the split does
    not depend on partitioning (``randomSplit`` does). ``mod`` puts
    ``key % round(1/fraction) == 0`` in test -- the form checked against SQL."""
    if method == "mod":
        m = int(round(1 / test_fraction))
        is_test = F.pmod(key, F.lit(m)) == 0
    elif method == "hash":
        buckets = 1_000_000
        is_test = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)) < F.lit(int(round(test_fraction * buckets)))
    else:
        raise ValueError("method must be 'hash' or 'mod'")
    return F.when(is_test, F.lit("test")).otherwise(F.lit("train"))


def train_test_split(df: DataFrame, key: str | list[str], test_fraction: float = 0.2, seed: int = 42,
                     method: str = "hash") -> tuple[DataFrame, DataFrame]:
    k = qcol(key) if isinstance(key, str) else F.struct(*[qcol(c) for c in key])
    tagged = df.withColumn("_split", split_column(k, test_fraction, seed, method))
    return (tagged.where(F.col("_split") == "train").drop("_split"),
            tagged.where(F.col("_split") == "test").drop("_split"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """share of rows whose prediction equals the label; ``(accuracy, n_rows)``."""
    return df.agg(F.avg((qcol(prediction).cast("double") == qcol(label).cast("double")).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n_rows"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """area under the ROC curve with tied scores counted half -- the
    Mann-Whitney statistic, which is what the trapezoid rule over the exact
    curve gives. Null with one class only.

    Scores are grouped (partial aggregate) and negatives below each score come
    from blockwise running sums: nothing is sorted in one task.
    """
    y = qcol(label).cast("double")
    per = (df.where(qcol(score).isNotNull() & y.isNotNull())
           .groupBy(qcol(score).cast("double").alias("s"))
           .agg(F.sum(y).alias("pos"), F.sum(1.0 - y).alias("neg")))
    cum = prefix_sums(per, ["neg"], F.col("s"))
    below = F.col("neg_cum") - F.col("neg")
    out = cum.agg(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("u"),
                  F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n")))
                      .alias("roc_auc"))
