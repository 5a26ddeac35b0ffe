"""Profiles that merge (D1, D3, D5): a stored state per part of a table.

A state has one row per column: counts, moments (count, mean, sum of squared
distances), smallest and largest number, and an HLL sketch of the distinct values.
States of disjoint parts merge to the state of the whole, so a table that grows is
profiled by reading its new part only. Counts and bounds are exact, moments exact
up to rounding, the distinct count is the sketch's estimate (about 1.6 % standard
error at ``LOG2_BUCKETS``; small counts are near exact). Merged sketches are estimated
by another rule than one sketch that saw every row, so the two may differ within that error.

Null and NaN are missing, as in D1. An empty part has counts of zero and null
moments, and changes nothing in a merge. A column that a part lacks is absent from
its state: its ``n_rows`` counts the parts that have it. A column whose type differs
between parts has one row per type. Repeated parts count twice unless they are
written under one part id: ``write_state`` overwrites that part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import as_text, is_numeric, nan_to_null, qcol
from .profile import _stack

LOG2_BUCKETS = 12
STATE_COLUMNS = ["pos", "column", "dtype", "n_rows", "n_missing", "mean", "m2", "low", "high", "distinct"]


def profile_state(df: DataFrame) -> DataFrame:
    """The state of one part: one aggregate over it, no distinct value is shuffled."""
    df = nan_to_null(df)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        x = qcol(f.name)
        v = x.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        # numbers keep 8-byte keys; other values are hashed as their text
        key = F.xxhash64(x + F.lit(0)) if is_numeric(f.dataType) else F.xxhash64(as_text(f.name, f.dataType))
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"), F.avg(v).alias(f"m{i}"),
                 (F.var_pop(v) * F.count(v)).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.hll_sketch_agg(F.when(x.isNotNull(), key), F.lit(LOG2_BUCKETS)).alias(f"d{i}")]
    return _stack(df.agg(*aggs), df.columns, {
        "dtype": lambda i: F.lit(fields[i].dataType.simpleString()), "n_rows": lambda i: F.col("rows"),
        "n_missing": lambda i: F.col(f"n{i}"), "mean": lambda i: F.col(f"m{i}"), "m2": lambda i: F.col(f"s{i}"),
        "low": lambda i: F.col(f"lo{i}"), "high": lambda i: F.col(f"hi{i}"), "distinct": lambda i: F.col(f"d{i}"),
    }).select(*STATE_COLUMNS)


def merge_states(states: DataFrame) -> DataFrame:
    """The state of the whole from the rows of its parts' states (``unionByName`` or a
    folder of parts). Squared distances are taken about the whole's mean, so a large
    common offset costs no digits."""
    keys = ["column", "dtype"]
    n = F.when(F.col("mean").isNotNull(), F.col("n_rows") - F.col("n_missing")).otherwise(F.lit(0))
    whole = (states.groupBy(*keys).agg(
        F.min("pos").alias("pos"), F.sum("n_rows").alias("all_rows"), F.sum("n_missing").alias("all_missing"),
        F.min("low").alias("all_low"), F.max("high").alias("all_high"), F.min("mean").alias("base"),
        F.hll_union_agg("distinct").alias("all_distinct")))
    parts = states.select(*keys, n.alias("n"), "mean", "m2").join(whole.select(*keys, "base"), keys)
    off = F.col("mean") - F.col("base")
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * off).alias("s"),
                                    F.sum(F.col("m2") + F.col("n") * off * off).alias("q"))
    shift = F.col("s") / F.nullif(F.col("n"), F.lit(0))
    return whole.join(sums, keys).select(
        "pos", "column", "dtype", F.col("all_rows").alias("n_rows"), F.col("all_missing").alias("n_missing"),
        (F.col("base") + shift).alias("mean"), F.greatest(F.col("q") - F.col("s") * shift, F.lit(0.0) * F.col("q")).alias("m2"),
        F.col("all_low").alias("low"), F.col("all_high").alias("high"), F.col("all_distinct").alias("distinct"))


def state_summary(state: DataFrame) -> DataFrame:
    """One readable row per column: ``(column, dtype, n_rows, n_missing, mean, std, min, max,
    approx_distinct)``; std is the sample's, null below two values."""
    n = F.col("n_rows") - F.col("n_missing")
    std = F.when(n > 1, F.sqrt(F.col("m2") / (n - 1)))
    return state.orderBy("pos", "dtype").select(
        "column", "dtype", "n_rows", "n_missing", "mean", std.alias("std"), F.col("low").alias("min"),
        F.col("high").alias("max"), F.hll_sketch_estimate("distinct").alias("approx_distinct"))


def write_state(df: DataFrame, path: str, part_id: int) -> None:
    """Store the state of one part; a replayed part overwrites itself."""
    profile_state(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={int(part_id)}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The stored states of all parts, for ``merge_states``."""
    return spark.read.parquet(path).select(*STATE_COLUMNS)
