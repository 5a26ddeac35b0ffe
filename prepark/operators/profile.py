"""Profiling: D1 shape/missing, D2 total, D3 column summary, D4 missing fraction,
D5/D5b describe, D6 field roles, D7 quick summary (a/b/c), D8 quality report.

All per-column results are small DataFrames (one row per column). Distinct
counting unpivots to ``(column, value)`` and groups with a partial aggregate,
so the shuffle carries distinct values, never whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import (
    as_text, is_integral, is_numeric, is_temporal, kind_of, missing, nan_to_null, numeric_columns, order_column, qcol,
)
from ..functions.patterns import (
    BINARY_TOKENS, DATETIME_NAME_PATTERN, ID_MIN_DISTINCT, ID_NAME_PATTERN, MAX_UNIQUE_FOR_CATEGORICAL, REPORT_AFTER,
    REPORT_BEFORE, REPORT_COLUMNS, REPORT_RULE, REPORT_TITLE, TARGET_NAMES, summary_text,
)
from .ordered import edges_of, exact_quantiles, quantile_blocks, sketch_of


def _spark(df: DataFrame):
    return df.sparkSession


def _schema_frame(df: DataFrame) -> DataFrame:
    """One row per column with its position and type facts (schema-sized)."""
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType), is_integral(f.dataType),
             is_numeric(f.dataType), is_temporal(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return _spark(df).createDataFrame(
        rows, "pos int, column string, dtype string, kind string, is_integral boolean, "
              "is_numeric boolean, is_temporal boolean")


def _stack(row_df: DataFrame, columns: list[str], fields: dict[str, callable]) -> DataFrame:
    """Turn a one-row aggregate with per-column fields into one row per column."""
    structs = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                        *[fn(i).alias(name) for name, fn in fields.items()]) for i, c in enumerate(columns)]
    return row_df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# --------------------------------------------------------------------- D1
def summary_stats(df: DataFrame) -> DataFrame:
    """``(column, n_rows, n_missing)``, one aggregate over the table."""
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(missing(qcol(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)])
    return _stack(agg, df.columns, {"n_rows": lambda i: F.col("rows"), "n_missing": lambda i: F.col(f"n{i}")}) \
        .select("column", "n_rows", "n_missing")


def summary_meta(df: DataFrame) -> dict:
    """D1 as the reference's dict ``{rows, cols, missing: {col: n}}`` (one row collected)."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(missing(qcol(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)]).first()
    return {"rows": row["rows"], "cols": len(fields), "missing": {f.name: row[f"n{i}"] for i, f in enumerate(fields)}}


# --------------------------------------------------------------------- D2
def missing_total(df: DataFrame) -> DataFrame:
    """Total number of missing cells."""
    fields = df.schema.fields
    total = F.lit(0).cast("bigint")
    for f in fields:
        total = total + missing(qcol(f.name), f.dataType).cast("bigint")
    return df.agg(F.coalesce(F.sum(total), F.lit(0).cast("bigint")).alias("total_missing"))


# --------------------------------------------------------------------- D4
def missing_fraction(df: DataFrame) -> DataFrame:
    """Share (0-1) of missing cells per column; null for an empty table.

    The reference names this ``missing_pct`` although it is a fraction.
    """
    fields = df.schema.fields
    agg = df.agg(*[F.avg(missing(qcol(f.name), f.dataType).cast("double")).alias(f"f{i}") for i, f in enumerate(fields)])
    return _stack(agg, df.columns, {"missing_frac": lambda i: F.col(f"f{i}")}).select("column", "missing_frac")


# --------------------------------------------------------------------- D7c
def missing_pct_avg(df: DataFrame) -> DataFrame:
    """Mean over columns of the missing share, times 100."""
    fields = df.schema.fields
    if not fields:
        return _spark(df).range(1).select(F.lit(None).cast("double").alias("missing_pct"))
    total = None
    for f in fields:
        term = F.avg(missing(qcol(f.name), f.dataType).cast("double"))
        total = term if total is None else total + term
    return df.agg((total / F.lit(len(fields)) * F.lit(100.0)).alias("missing_pct"))


# --------------------------------------------------------------------- D3
# Values up to this many characters are grouped as they are; longer ones (whole
# documents, pages) by a fingerprint of the whole text, so the shuffle carries
# 16 bytes instead of the text. The few sample texts are fetched back afterwards.
LONG_TEXT = 64


def value_key(v: Column) -> Column:
    """Grouping key of a text value: the value itself when short, else its
    beginning (for ties) and (xxhash64, murmur3, length) of the whole text."""
    short = F.length(v) <= LONG_TEXT
    return F.struct(F.when(short, v).alias("s"), F.when(~short, F.substring(v, 1, LONG_TEXT)).alias("head"),
                    F.when(~short, F.xxhash64(v)).alias("h1"),
                    F.when(~short, F.hash(v)).alias("h2"), F.when(~short, F.length(v)).alias("n"))


def long_text_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns holding any value longer than ``LONG_TEXT`` (one aggregate, no shuffle)."""
    if not columns:
        return []
    row = df.agg(*[F.max(F.length(qcol(c).cast("string"))).alias(f"l{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if (row[f"l{i}"] or 0) > LONG_TEXT]


def distinct_profile(df: DataFrame, columns: list[str] | None = None, order_by=None,
                     n_values: int = 5, approx: bool = False, long_cols: list[str] | None = None) -> DataFrame:
    """Per column: ``n_unique`` (missing excluded) and the first ``n_values``
    distinct values in order of appearance (as text, in an array).

    One unpivot + ``groupBy(column, value key)`` (partial aggregate); the
    top-n per column is a ``row_number <= n`` filter, planned as a
    WindowGroupLimit that trims each partition before the exchange. In columns
    with long texts (``long_cols``, found by one cheap aggregate if not given)
    they travel as fingerprints, and the <= n sample texts are read back by a
    broadcast lookup on their first position (a scan, no shuffle of texts).
    """
    cols = columns if columns is not None else df.columns
    if long_cols is None:
        long_cols = long_text_columns(df, cols)
    df, order, _ = order_column(df, order_by)
    fields = {f.name: f.dataType for f in df.schema.fields}
    structs = [F.struct(F.lit(c).alias("column"),
                        F.when(missing(qcol(c), fields[c]), F.lit(None)).otherwise(as_text(c, fields[c])).alias("v"))
               for c in cols]
    long = (df.select(order.alias("_o"), F.explode(F.array(*structs)).alias("kv"))
            .select("_o", "kv.column", "kv.v").where(F.col("v").isNotNull()))
    long = long.withColumn("k", value_key(F.col("v")) if long_cols else F.struct(F.col("v").alias("s")))
    firsts = long.groupBy("column", "k").agg(F.min("_o").alias("_first"))
    if approx:
        uniq = long.groupBy("column").agg(F.approx_count_distinct("k").alias("n_unique"))
    else:
        uniq = firsts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    rn = F.row_number().over(Window.partitionBy("column").orderBy("_first", "k"))
    top = firsts.withColumn("_r", rn).where(F.col("_r") <= n_values).withColumn("v", F.col("k.s"))
    if long_cols:
        keys = top.where(F.col("v").isNull()).select("column", "k", F.col("_first").alias("_o"))  # <= n per column
        texts = (long.where(F.col("column").isin(long_cols)).join(F.broadcast(keys), on=["column", "k", "_o"])
                 .groupBy("column", "k").agg(F.min("v").alias("_text")))
        top = top.join(texts, on=["column", "k"], how="left").withColumn("v", F.coalesce("v", "_text"))
    top = (top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_r", "v"))).alias("_vals"))
           .select("column", F.transform("_vals", lambda s: s["v"]).alias("sample_values")))
    return uniq.join(top, on="column", how="full")


def column_summary(df: DataFrame, order_by=None, n_values: int = 5, approx: bool = False,
                   separator: str = " | ") -> DataFrame:
    """D3: ``(column, dtype, n_missing, n_unique, sample_values)``; sample values
    are the first distinct non-missing values in order, joined as text.

    One aggregate gives the missing counts and the longest value per column
    (which columns need fingerprints); one distinct pass gives the rest."""
    meta = _schema_frame(df)
    fields = [f for f in df.schema.fields if f.name != "_order"]
    cols = [f.name for f in fields]
    row = df.agg(*[F.count_if(missing(qcol(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)],
                 *[F.max(F.length(qcol(c).cast("string"))).alias(f"l{i}") for i, c in enumerate(cols)]).first()
    miss = _spark(df).createDataFrame([(c, row[f"n{i}"]) for i, c in enumerate(cols)], "column string, n_missing bigint")
    long_cols = [c for i, c in enumerate(cols) if (row[f"l{i}"] or 0) > LONG_TEXT]
    prof = distinct_profile(df, cols, order_by, n_values, approx, long_cols=long_cols)
    return (meta.join(miss, on="column").join(prof, on="column", how="left")
            .select("pos", "column", "dtype", "n_missing",
                    F.coalesce(F.col("n_unique"), F.lit(0).cast("bigint")).alias("n_unique"),
                    F.coalesce(F.array_join("sample_values", separator), F.lit("")).alias("sample_values"))
            .orderBy("pos").drop("pos"))


# --------------------------------------------------------------------- D5
def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std (sample), min, 25/50/75 % (linear interpolation), max.

    Exact percentiles come from ``exact_quantiles`` (distributed); ``approx``
    uses ``percentile_approx`` in the same single aggregate instead.
    ``df.summary()`` is not used: its percentiles are approximate.
    """
    df = nan_to_null(df)
    cols = columns if columns is not None else numeric_columns(df)
    spark = _spark(df)
    if not cols:
        return spark.createDataFrame([], "column string, count bigint, mean double, std double, min double, "
                                         "p25 double, p50 double, p75 double, max double")
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 100000).alias(f"q{i}") if approx
                    else sketch_of(c).alias(f"s_{i}"))
    if not approx:
        # one row of statistics, and the quantile blocks' edges from its sketches
        n_blocks = quantile_blocks(df)
        row = df.agg(*aggs).select("*", *[edges_of(F.col(f"s_{i}"), F.col(f"n{i}"), n_blocks).alias(f"e{i}") for i, _ in enumerate(cols)]).drop(
            *[f"s_{i}" for i, _ in enumerate(cols)]).first()
        stats = spark.createDataFrame(
            [(i, c, *(row[f"{k}{i}"] for k in ("n", "m", "s", "lo", "hi"))) for i, c in enumerate(cols)],
            "pos int, column string, count bigint, mean double, std double, min double, max double")
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], n_blocks, edges={c: row[f"e{i}"] for i, c in enumerate(cols)})
        q = q.groupBy("column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value")).toDF("column", "p25", "p50", "p75")
        return (stats.join(q, on="column", how="left").orderBy("pos")
                .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))
    stats = _stack(df.agg(*aggs), cols, {
        "count": lambda i: F.col(f"n{i}"), "mean": lambda i: F.col(f"m{i}"), "std": lambda i: F.col(f"s{i}"),
        "min": lambda i: F.col(f"lo{i}"), "max": lambda i: F.col(f"hi{i}"),
        "q": lambda i: F.col(f"q{i}").cast("array<double>"),
    })
    return stats.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"),
                        F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def describe_auto(df: DataFrame) -> DataFrame:
    """``df.describe()`` as pandas picks it: numeric summary (D5) when any
    numeric column exists, else the text summary (D5b)."""
    return describe(df) if numeric_columns(df) else describe_text(df)


def describe_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, unique, top, freq per text column; ties go to the smallest value.

    Values are counted by ``value_key``, so long texts travel as fingerprints.
    The top is the smallest value among those with the highest count: when
    every value is unique that is the column's minimum (a partial aggregate);
    otherwise the tied long texts, if any, are read back through a
    size-checked join.
    """
    from .joins import maybe_broadcast

    df = nan_to_null(df)  # NaN is missing, as in D3
    cols = columns if columns is not None else df.columns
    if not long_text_columns(df, cols):
        # short values only: group the values themselves, one job
        short = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("v")) for c in cols
        ])).alias("kv")).select("kv.*").where(F.col("v").isNotNull())
        counts = short.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("column").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by("v", F.struct((-F.col("n")).alias("neg"), F.col("v"))).alias("top"), F.max("n").alias("freq"))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("v")) for c in cols
    ])).alias("kv")).select("kv.*").where(F.col("v").isNotNull()).withColumn("k", value_key(F.col("v")))
    counts = long.groupBy("column", "k").agg(F.count(F.lit(1)).alias("n"))
    per_col = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq"))
    ties = counts.join(per_col.select("column", "freq"), on="column").where(F.col("n") == F.col("freq"))
    short_top = ties.groupBy("column").agg(F.min("k.s").alias("_short"))
    long_ties = ties.where(F.col("k.s").isNull()).select("column", "k")
    stats = {r["column"]: r["freq"] for r in per_col.select("column", "freq").collect()}  # one row per column
    all_unique = [c for c, f in stats.items() if f == 1]
    parts = []
    if all_unique:
        parts.append(long.where(F.col("column").isin(all_unique)).groupBy("column").agg(F.min("v").alias("_long")))
    rest = [c for c in stats if c not in all_unique]
    if rest and long_ties.where(F.col("column").isin(rest)).limit(1).count() > 0:
        wanted = long_ties.where(F.col("column").isin(rest))
        parts.append(long.join(maybe_broadcast(wanted), on=["column", "k"])
                     .groupBy("column").agg(F.min("v").alias("_long")))
    out = per_col.join(short_top, on="column", how="left")
    if parts:
        lt = parts[0]
        for p_ in parts[1:]:
            lt = lt.unionByName(p_)
        out = out.join(lt, on="column", how="left")
        top = F.when(F.col("_short").isNull(), F.col("_long")).when(F.col("_long").isNull(), F.col("_short")) \
            .otherwise(F.least("_short", "_long"))
    else:
        top = F.col("_short")
    return out.select("column", "count", "unique", top.alias("top"), "freq")


# --------------------------------------------------------------------- D6
def field_roles(df: DataFrame, max_unique_for_categorical: int = MAX_UNIQUE_FOR_CATEGORICAL,
                approx: bool = False) -> DataFrame:
    """``(column, dtype, nunique, pct_null, role, likely_target)``.

    Rules, first hit wins: id (name pattern, or integer with > 50 distinct
    values and no repeats), numeric, datetime (type or name), categorical
    (<= 50 distinct), text. The id rule compares distinct and non-missing
    counts for equality, so distinct counts are exact unless ``approx``.
    """
    meta = _schema_frame(df)
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(missing(qcol(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)])
    nulls = _stack(agg, df.columns, {"rows": lambda i: F.col("rows"), "n_missing": lambda i: F.col(f"n{i}")})
    fields_map = {f.name: f.dataType for f in fields}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(missing(qcol(c), fields_map[c]), F.lit(None)).otherwise(as_text(c, fields_map[c])).alias("v"))
        for c in df.columns])).alias("kv")).select("kv.*").where(F.col("v").isNotNull())
    if approx:
        uniq = long.groupBy("column").agg(F.approx_count_distinct("v").alias("nunique"))
    else:
        uniq = (long.select("column", value_key(F.col("v")).alias("k")).distinct()
                .groupBy("column").agg(F.count(F.lit(1)).alias("nunique")))
    t = (meta.join(nulls.select("column", "rows", "n_missing"), on="column")
         .join(uniq, on="column", how="left")
         .withColumn("nunique", F.coalesce("nunique", F.lit(0).cast("bigint"))))
    name_is_id = F.col("column").rlike("(?i)" + ID_NAME_PATTERN)
    int_unique = (F.col("is_integral") & (F.col("nunique") > ID_MIN_DISTINCT)
                  & (F.col("nunique") == F.col("rows") - F.col("n_missing")))
    role = (F.when(name_is_id | int_unique, "id")
            .when(F.col("is_numeric"), "numeric")
            .when(F.col("is_temporal") | F.col("column").rlike("(?i)" + DATETIME_NAME_PATTERN), "datetime")
            .when(F.col("nunique") <= max_unique_for_categorical, "categorical")
            .otherwise("text"))
    pct = F.when(F.col("rows") > 0, F.col("n_missing") / F.col("rows"))
    return t.orderBy("pos").select(
        "column", "dtype", "nunique", pct.alias("pct_null"), role.alias("role"),
        F.lower("column").isin(TARGET_NAMES).alias("likely_target"))


# --------------------------------------------------------------------- D7a
def top_variance(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` numeric columns with the largest sample variance."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    if not cols:
        return _spark(df).createDataFrame([], "column string, variance double")
    agg = df.agg(*[F.var_samp(qcol(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    st = _stack(agg, cols, {"variance": lambda i: F.col(f"v{i}")})
    return (st.orderBy(F.col("variance").desc_nulls_last(), F.col("pos")).limit(n)
            .select("column", "variance"))


# --------------------------------------------------------------------- D7b
def _token_text(c: Column, dt: T.DataType, compat: bool) -> Column:
    if compat:
        if isinstance(dt, T.BooleanType):
            return F.when(c, "True").when(~c, "False")
        return c.cast("string")
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
    return F.lower(c.cast("string"))


def binary_targets(df: DataFrame, roles: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Candidate binary targets, ``(column)`` in schema order.

    Role-flagged columns (``likely_target``) win; otherwise columns with at
    most 3 distinct values, all of them 0/1/yes/no/true/false as text.
    Ours compares lower-cased text, accepts int-valued doubles and skips
    all-missing columns; ``compat`` keeps the reference's quirks.
    """
    pos = _schema_frame(df).select("pos", "column")
    if roles is not None:
        flagged = roles.where("likely_target").select("column")
        if flagged.limit(1).count() > 0:
            return flagged.join(pos, on="column").orderBy("pos").select("column")
    fields = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(missing(qcol(c), fields[c]), F.lit(None)).otherwise(_token_text(qcol(c), fields[c], compat)).alias("v"))
        for c in df.columns])).alias("kv")).select("kv.*").where(F.col("v").isNotNull())
    # only short values can be tokens: long texts are grouped by fingerprint and never match
    keyed = long.select("column", value_key(F.col("v")).alias("k")).distinct()
    per_col = keyed.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce(F.col("k.s").isin(BINARY_TOKENS), F.lit(False))).alias("ok"))
    hits = per_col.where((F.col("n") <= 3) & F.col("ok")).select("column")
    if compat:  # an all-missing column matches in pandas (empty set is a subset)
        nonnull = per_col.select("column")
        hits = hits.unionByName(pos.select("column").join(nonnull, on="column", how="left_anti"))
    return hits.join(pos, on="column").orderBy("pos").select("column")


# --------------------------------------------------------------------- D7
def quick_summary(df: DataFrame, roles: DataFrame | None = None, max_preview_rows: int = 5,
                  order_by=None) -> dict:
    """Summary sentences, a preview frame and candidate targets.

    The inputs are small per-column frames; only they are collected.
    """
    from ..sources.files import preview  # local import: sources depend on operators

    shape = summary_meta(df)
    nrows, ncols = shape["rows"], shape["cols"]
    nums = numeric_columns(df)
    pct = missing_pct_avg(df).first()["missing_pct"] or 0.0
    top = [r["column"] for r in top_variance(df).collect()]
    targets = [r["column"] for r in binary_targets(df, roles).collect()]
    text = summary_text(nrows, ncols, targets, nums, pct, top)
    return {"summary_text": text, "preview_df": preview(df, max_preview_rows, order_by=order_by),
            "candidate_targets": targets}


# --------------------------------------------------------------------- D8
def quality_report(before: DataFrame, after: DataFrame, summary: DataFrame) -> DataFrame:
    """The quality report as a long frame ``(section, column, metric, value)``.

    ``before``/``after`` are D1 frames, ``summary`` a D3 frame. Text rendering
    of the same rows is ``render_report``.
    """
    def shape(d: DataFrame, section: str) -> DataFrame:
        rows = d.select(F.lit(section).alias("section"), F.lit("").alias("column"), F.lit("rows").alias("metric"),
                        F.col("n_rows").cast("string").alias("value")).limit(1)
        cols = d.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(section).alias("section"), F.lit("").alias("column"), F.lit("cols").alias("metric"),
            F.col("n").cast("string").alias("value"))
        miss = d.select(F.lit(section).alias("section"), "column", F.lit("missing").alias("metric"),
                        F.col("n_missing").cast("string").alias("value"))
        return rows.unionByName(cols).unionByName(miss)

    return shape(before, "before").unionByName(shape(after, "after")).unionByName(_summary_rows(summary))


def _summary_rows(summary: DataFrame) -> DataFrame:
    """A D3 frame as report rows ``(column_summary, column, metric, value)``."""
    return summary.select(F.lit("column_summary").alias("section"), "column", F.explode(F.array(
        F.struct(F.lit("dtype").alias("metric"), F.col("dtype").alias("value")),
        F.struct(F.lit("n_missing").alias("metric"), F.col("n_missing").cast("string").alias("value")),
        F.struct(F.lit("n_unique").alias("metric"), F.col("n_unique").cast("string").alias("value")),
        F.struct(F.lit("sample_values").alias("metric"), F.col("sample_values").alias("value")),
    )).alias("m")).select("section", "column", "m.metric", "m.value")


def report_from_meta(spark, meta: dict, summary: DataFrame) -> DataFrame:
    """D8 from C3's metadata (no scan: "before"/"after" are already counted)
    plus a D3 frame; the same rows as ``quality_report``."""
    rows = []
    for section in ("before", "after"):
        m = meta[section]
        rows += [(section, "", "rows", str(m["rows"])), (section, "", "cols", str(m["cols"]))]
        rows += [(section, c, "missing", str(n)) for c, n in m["missing"].items()]
    shape = spark.createDataFrame(rows, "section string, column string, metric string, value string")
    return shape.unionByName(_summary_rows(summary))


def render_report(meta: dict, summary_rows: list) -> str:
    """Text form of D8 from the small collected parts (reference layout)."""
    lines = [REPORT_TITLE, REPORT_RULE, REPORT_BEFORE, str(meta.get("before")),
             REPORT_AFTER, str(meta.get("after")), REPORT_COLUMNS]
    if summary_rows:
        keys = list(summary_rows[0].asDict().keys())
        lines.append("  ".join(keys))
        for r in summary_rows:
            lines.append("  ".join(str(r[k]) for k in keys))
    return "\n".join(lines)
