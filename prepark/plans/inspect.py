"""Data inspector (the reference's third entry point): PII scan, field roles,
column summary and quick summary of one table, sharing its passes.

Separately, D3, D5b, D6 and D7b each unpivot the table and shuffle its
distinct values. Here that happens once: one aggregate gives shape, missing
counts and variances; one ``groupBy(column, value)`` (partial aggregate) gives
every distinct value's first position and count, and is checkpointed to the
shared folder; all per-column reports are small derivations of those two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import as_text, missing, numeric_columns, order_column, qcol
from ..functions.patterns import (
    BINARY_TOKENS, DATETIME_NAME_PATTERN, ID_MIN_DISTINCT, ID_NAME_PATTERN, MAX_UNIQUE_FOR_CATEGORICAL, TARGET_NAMES,
    summary_text,
)
from ..operators.pii import pii_detect
from ..operators.profile import _schema_frame, value_key
from ..session import materialize
from ..sources.files import preview


def _long(df: DataFrame, order_by=None) -> DataFrame:
    cols = [c for c in df.columns if c != "_order"]
    types = {f.name: f.dataType for f in df.schema.fields}
    df, order, _ = order_column(df, order_by)
    long = (df.select(order.alias("_o"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(missing(qcol(c), types[c]), F.lit(None)).otherwise(as_text(c, types[c])).alias("v"))
        for c in cols])).alias("kv")).select("_o", "kv.column", "kv.v").where(F.col("v").isNotNull()))
    return long.withColumn("k", value_key(F.col("v")))


def distinct_values(df: DataFrame, order_by=None, checkpoint: bool = True) -> DataFrame:
    """``(column, k, first, n)`` for every distinct non-missing value; ``k`` is
    the value key (the text itself, or a fingerprint of a long text)."""
    dist = _long(df, order_by).groupBy("column", "k").agg(F.min("_o").alias("first"), F.count(F.lit(1)).alias("n"))
    return materialize(dist) if checkpoint else dist


def _fetch_texts(df: DataFrame, order_by, wanted: DataFrame) -> DataFrame:
    """Texts of a few (column, k, first) keys, by a broadcast lookup on their
    first position: a scan of the source, no shuffle of its texts."""
    keys = wanted.select("column", "k", F.col("first").alias("_o")).distinct()
    return (_long(df, order_by).join(F.broadcast(keys), on=["column", "k", "_o"])
            .groupBy("column", "k").agg(F.min("v").alias("_text")))


def inspect(df: DataFrame, order_by=None, max_unique_for_categorical: int = MAX_UNIQUE_FOR_CATEGORICAL,
            n_values: int = 5, pii: bool = True, checkpoint: bool = True) -> dict:
    """Everything the inspector shows, as small DataFrames plus the summary text.

    Keys: ``roles`` (D6), ``column_summary`` (D3), ``describe_text`` (D5b, every
    column), ``top_variance`` (D7a), ``binary_targets`` (D7b), ``pii`` (E1),
    ``summary_text`` / ``candidate_targets`` (D7), ``preview``.
    """
    fields = [f for f in df.schema.fields if f.name != "_order"]
    cols = [f.name for f in fields]
    meta = _schema_frame(df.select(*[qcol(c) for c in cols]))
    nums = numeric_columns(df.select(*[qcol(c) for c in cols]))
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(missing(qcol(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)],
                 *[F.var_samp(qcol(c)).alias(f"v{i}") for i, c in enumerate(nums)]).first()
    rows = agg["rows"]
    miss = {f.name: agg[f"n{i}"] for i, f in enumerate(fields)}
    spark = df.sparkSession
    per_col = spark.createDataFrame([(c, rows, miss[c]) for c in cols], "column string, rows bigint, n_missing bigint")

    dist = distinct_values(df, order_by, checkpoint)
    # most frequent value, ties to the smallest (long texts with one beginning tie by their fingerprints)
    stats = dist.groupBy("column").agg(
        F.count(F.lit(1)).alias("nunique"),
        F.min_by(F.struct("k", "first"), F.struct((-F.col("n")).alias("neg"), F.coalesce("k.s", "k.head").alias("text"), F.col("k"))).alias("_top"),
        F.max("n").alias("freq"))
    rn = F.row_number().over(Window.partitionBy("column").orderBy("first", "k"))
    first_rows = dist.withColumn("_r", rn).where(F.col("_r") <= n_values)  # <= n per column
    wanted = first_rows.select("column", "k", "first").unionByName(
        stats.select("column", F.col("_top.k").alias("k"), F.col("_top.first").alias("first"))
    ).where(F.col("k.s").isNull())
    texts = _fetch_texts(df, order_by, wanted) if wanted.limit(1).count() > 0 else None

    def with_text(frame: DataFrame, key: str) -> DataFrame:
        frame = frame.withColumn("v", F.col(f"{key}.s"))
        if texts is None:
            return frame
        t = texts.withColumnRenamed("k", "_tk")
        return (frame.join(t, (frame["column"] == t["column"]) & (frame[key] == t["_tk"]), "left")
                .drop(t["column"]).drop("_tk").withColumn("v", F.coalesce("v", "_text")).drop("_text"))

    stats = with_text(stats.withColumn("_tkey", F.col("_top.k")), "_tkey").withColumnRenamed("v", "top")
    firsts = (with_text(first_rows, "k").groupBy("column")
              .agg(F.array_sort(F.collect_list(F.struct("_r", "v"))).alias("_vals"))
              .select("column", F.transform("_vals", lambda s: s["v"]).alias("sample_values")))
    t = (meta.join(per_col, on="column").join(stats, on="column", how="left").join(firsts, on="column", how="left")
         .withColumn("nunique", F.coalesce("nunique", F.lit(0).cast("bigint"))))

    name_is_id = F.col("column").rlike("(?i)" + ID_NAME_PATTERN)
    int_unique = (F.col("is_integral") & (F.col("nunique") > ID_MIN_DISTINCT)
                  & (F.col("nunique") == F.col("rows") - F.col("n_missing")))
    role = (F.when(name_is_id | int_unique, "id").when(F.col("is_numeric"), "numeric")
            .when(F.col("is_temporal") | F.col("column").rlike("(?i)" + DATETIME_NAME_PATTERN), "datetime")
            .when(F.col("nunique") <= max_unique_for_categorical, "categorical").otherwise("text"))
    roles = t.orderBy("pos").select("column", "dtype", "nunique",
                                    F.when(F.col("rows") > 0, F.col("n_missing") / F.col("rows")).alias("pct_null"),
                                    role.alias("role"), F.lower("column").isin(TARGET_NAMES).alias("likely_target"))
    column_summary = t.orderBy("pos").select(
        "column", "dtype", "n_missing", F.col("nunique").alias("n_unique"),
        F.coalesce(F.array_join("sample_values", " | "), F.lit("")).alias("sample_values"))
    describe_text = t.where(F.col("nunique") > 0).orderBy("pos").select(
        "column", (F.col("rows") - F.col("n_missing")).alias("count"), F.col("nunique").alias("unique"), "top", "freq")

    # D7b from the same distinct table: <= 3 values, all binary tokens (ints printed as floats normalised)
    floaty = [f.name for f in fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))]
    short = F.col("k.s")  # binary tokens are short; a long text is never one
    token = F.lower(F.when(F.col("column").isin(floaty) if floaty else F.lit(False),
                           F.regexp_replace(short, r"\.0+$", "")).otherwise(short))
    binary = (dist.groupBy("column").agg(F.count(F.lit(1)).alias("_nk"),
                                         F.bool_and(F.coalesce(token.isin(BINARY_TOKENS), F.lit(False))).alias("ok"))
              .where((F.col("_nk") <= 3) & F.col("ok")).join(meta.select("pos", "column"), on="column")
              .orderBy("pos").select("column"))
    flagged = [r["column"] for r in roles.where("likely_target").select("column").collect()]
    targets = flagged or [r["column"] for r in binary.collect()]

    variances = sorted(((agg[f"v{i}"], i, c) for i, c in enumerate(nums) if agg[f"v{i}"] is not None),
                       key=lambda x: (-x[0], x[1]))[:3]
    top_variance = spark.createDataFrame([(c, v) for v, _, c in variances], "column string, variance double")
    pct = (sum(miss.values()) / (rows * len(cols)) * 100.0) if rows and cols else 0.0
    text = summary_text(rows, len(cols), targets, nums, pct, [c for _, _, c in variances])
    out = {"roles": roles, "column_summary": column_summary, "describe_text": describe_text,
           "top_variance": top_variance, "binary_targets": binary, "candidate_targets": targets,
           "summary_text": text, "preview": preview(df.select(*[qcol(c) for c in cols]), 5, order_by=order_by)}
    if pii:
        out["pii"] = pii_detect(df, order_by=order_by)
    return out


__all__ = ["inspect", "distinct_values"]
