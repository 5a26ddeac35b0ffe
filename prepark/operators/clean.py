"""Cleaning operators: B6 drop missing, B7 3-sigma filter, C1/C8 impute, C2 text fill,
C4 dedupe, C5 forward/backward fill, C7 standard scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import (
    is_integral, is_numeric, is_temporal, is_text, missing, nan_to_null, numeric_columns,
    order_column, qcol, text_columns,
)
from ..functions.patterns import TEXT_FILL
from .columns import trim_columns
from .ordered import exact_quantiles, ffill_bfill


# --------------------------------------------------------------------- B6
def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (null or NaN)."""
    return df.dropna(how="any", subset=subset)


# --------------------------------------------------------------------- B7
def sigma_bounds(df: DataFrame, columns: list[str], k: float = 3.0) -> dict[str, tuple[float | None, float | None]]:
    """Mean -/+ k sample standard deviations of each column, in one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_samp(qcol(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None or s is None or math.isnan(s):
            out[c] = (None, None)
        else:
            out[c] = (m - k * s, m + k * s)
    return out


def within_bounds(c: str, lo: float | None, hi: float | None) -> Column:
    if lo is None or hi is None:
        return F.lit(False)  # sigma undefined (0-1 rows or all missing): pandas drops every row
    return (qcol(c) > F.lit(lo)) & (qcol(c) < F.lit(hi))


def three_sigma(df: DataFrame, columns: list[str] | None = None, k: float = 3.0,
                mode: str = "sequential", exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Keep rows with mean - k*sd < x < mean + k*sd (strict), per numeric column.

    ``sequential`` (the reference): bounds of each column are computed on the
    rows left by the earlier columns -- one small aggregate per column, each
    reading only the columns it filters on. ``single_pass``: all bounds from
    one aggregate over the input. A constant column drops every row (sd = 0).
    Callers with an expensive input plan should checkpoint it first.
    """
    df = nan_to_null(df)
    cols = columns if columns is not None else numeric_columns(df, exclude)
    if mode == "single_pass":
        bounds = sigma_bounds(df, cols, k)
        cond = F.lit(True)
        for c in cols:
            cond = cond & within_bounds(c, *bounds[c])
        return df.where(cond)
    if mode != "sequential":
        raise ValueError("mode must be 'sequential' or 'single_pass'")
    cur = df
    for c in cols:
        lo, hi = sigma_bounds(cur, [c], k)[c]
        cur = cur.where(within_bounds(c, lo, hi))
    return cur


# ----------------------------------------------------------------- C1 / C8
def _medians(df: DataFrame, columns: list[str], approx: bool) -> dict[str, float | None]:
    if not columns:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(qcol(c).cast("double"), 0.5, 100000).alias(f"q{i}")
                       for i, c in enumerate(columns)]).first()
        return {c: row[f"q{i}"] for i, c in enumerate(columns)}
    rows = exact_quantiles(df, columns, [0.5]).collect()  # one row per column: schema-sized
    got = {r["column"]: r["value"] for r in rows}
    return {c: got.get(c) for c in columns}


def _modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent non-missing value per column; ties go to the smallest value."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("v")) for c in columns
    ])).alias("kv")).select("kv.*").where(F.col("v").isNotNull())
    counts = long.groupBy("column", "v").count()
    rows = counts.groupBy("column").agg(
        F.min_by("v", F.struct((-F.col("count")).alias("n"), F.col("v"))).alias("mode")).collect()
    got = {r["column"]: r["mode"] for r in rows}
    return {c: got.get(c) for c in columns}


def fill_values(df: DataFrame, strategy: dict | None = None, approx: bool = False,
                compat: bool = False) -> dict:
    """C1/C8 plan: the fill value of every column plus per-column missing counts.

    Strategy keys: ``numeric`` in {median, mean, zero, ffill}, ``categorical`` a literal or
    ``mode``. ``ffill`` gives numbers no fill value: ``impute`` carries the last one forward. Returns
    ``{"rows", "missing": {col: n}, "fill": {col: value}, "to_double": [cols]}``.
    One aggregate computes the counts (and means); medians add one distributed
    quantile job; nothing but scalars reaches the driver.
    """
    strategy = {"numeric": "median", "categorical": TEXT_FILL, **(strategy or {})}
    fields = df.schema.fields
    num = [f.name for f in fields if is_numeric(f.dataType)]
    tmp = [f.name for f in fields if is_temporal(f.dataType)]
    txt = [f.name for f in fields if is_text(f.dataType)]
    boo = [f.name for f in fields if isinstance(f.dataType, T.BooleanType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(missing(qcol(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)]
    if strategy["numeric"] == "mean":
        aggs += [F.avg(qcol(c)).alias(f"a{i}") for i, c in enumerate(num)]
    row = df.agg(*aggs).first()
    result = {"rows": row["__rows"], "missing": {f.name: row[f"n{i}"] for i, f in enumerate(fields)},
              "fill": {}, "to_double": []}
    nstrat = strategy["numeric"]
    # only columns with gaps need a fill value: no quantile work for complete columns
    gaps = {c for c, n in result["missing"].items() if n > 0}
    if nstrat == "median":
        need = [c for c in num if c in gaps]
        med = _medians(df, need, approx)
        result["fill"].update({c: med[c] for c in need})
    elif nstrat == "mean":
        result["fill"].update({c: row[f"a{i}"] for i, c in enumerate(num)})
    elif nstrat == "zero":
        result["fill"].update({c: 0.0 for c in num})
    elif nstrat != "ffill":
        raise ValueError(f"unknown numeric strategy {nstrat!r}")
    tmp = [c for c in tmp if c in gaps]
    if tmp:
        micros = df.select(*[F.unix_micros(qcol(c).cast("timestamp")).alias(c) for c in tmp])
        med = _medians(micros, tmp, approx) if nstrat == "median" else {}
        result["fill"].update({c: ("__micros__", med.get(c)) for c in tmp})
    cstrat = strategy["categorical"]
    text_targets = txt + (boo if compat else [])
    if cstrat == "mode":
        result["fill"].update(_modes(df, [c for c in text_targets if c in gaps]))
    else:
        result["fill"].update({c: cstrat for c in text_targets})
    # pandas turns an integer column with gaps into float before filling it
    result["to_double"] = [c for c in num if is_integral(df.schema[c].dataType) and result["missing"][c] > 0]
    return result


def apply_fill(df: DataFrame, plan: dict, compat: bool = False) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, dt = f.name, f.dataType
        v = plan["fill"].get(c)
        col = qcol(c)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            col = F.when(F.isnan(col), F.lit(None)).otherwise(col)
        if c in plan["to_double"]:
            col = col.cast("double")
        if compat and isinstance(dt, T.BooleanType):
            col = F.when(col, F.lit("True")).when(~col, F.lit("False"))
        if isinstance(v, tuple) and v and v[0] == "__micros__":
            if v[1] is not None:
                ts = F.timestamp_micros(F.lit(int(round(v[1]))))
                col = F.coalesce(col, ts.cast(dt))
        elif v is not None:
            lit = F.lit(v).cast("double" if c in plan["to_double"] else dt) if is_numeric(dt) else F.lit(v)
            col = F.coalesce(col, lit)
        out.append(col.alias(c))
    return df.select(*out)


def impute(df: DataFrame, strategy: dict | None = None, approx: bool = False, compat: bool = False,
           order_by: str | list[str] | None = None) -> DataFrame:
    """Text -> ``"missing"``; numbers -> column median; all-missing columns stay missing.

    Booleans keep their nulls unless ``compat`` (then they become text and are
    filled, as pandas' object columns are). Timestamps get the median instant.
    ``{"numeric": "ffill"}`` carries each number column forward in ``order_by`` order
    (file order if none); leading gaps stay.
    """
    out = apply_fill(df, fill_values(df, strategy, approx, compat), compat)
    if (strategy or {}).get("numeric") == "ffill":
        out, order, helpers = order_column(out, order_by)
        keys = {order_by} if isinstance(order_by, str) else {*(order_by or []), *helpers}
        out = ffill_bfill(out, [c for c in numeric_columns(out) if c not in keys], order, backward=False).drop(*helpers)
    return out


# --------------------------------------------------------------------- C2
def text_fill(df: DataFrame, value: str = TEXT_FILL) -> DataFrame:
    """Trim column names, fill text columns only; numbers untouched."""
    df = trim_columns(df)
    cols = text_columns(df)
    return df.fillna(value, subset=cols) if cols else df


# --------------------------------------------------------------------- C4
def dedupe(df: DataFrame, subset: list[str] | None = None, order_by: str | list[str] | None = None,
           keep_order: bool = True, order_is_position: bool = False) -> DataFrame:
    """C4: remove exact duplicate rows, keeping the first; missing equals missing.

    Whole rows are compared, the ``order_by`` columns included. Only with
    ``order_is_position`` (the order column numbers the rows and is no data) are they
    left out of the equality; the same holds for the file order.

    With ``keep_order`` the first position of each kept row is returned in the
    order column (``order_by`` if given, else the file order), so later
    order-dependent steps (C5) still see the original order. The aggregate is
    partial, so a hot duplicate group collapses before the shuffle.
    """
    if not keep_order:
        return df.dropDuplicates(subset) if subset else df.dropDuplicates()
    data_cols = df.columns
    df, order, helpers = order_column(df, order_by)
    if order_by is not None and not order_is_position and not subset:
        # equal rows have equal order keys: any of them is the first
        if not isinstance(order_by, str) and "_order" not in df.columns:
            df = df.withColumn("_order", order)
        return df.dropDuplicates(data_cols)
    if isinstance(order_by, str):
        name = order_by
    elif order_by is None:
        name = helpers[0] if helpers else "_order"
    else:
        name = "_order"
    keys = subset or [c for c in df.columns if c != name and c not in (order_by or [])]
    if subset:
        other = [c for c in df.columns if c not in keys and c != name]
        return df.groupBy(*[qcol(c) for c in keys]).agg(
            F.min_by(F.struct(*[qcol(c) for c in other]), order).alias("_rest") if other else F.lit(None).alias("_rest"),
            F.min(order).alias(name)).select(*keys, *([f"_rest.{c}" for c in other] if other else []), name)
    return df.groupBy(*[qcol(c) for c in keys]).agg(F.min(order).alias(name))


# --------------------------------------------------------------------- C5
def fill_forward_backward(df: DataFrame, columns: list[str] | None = None,
                          order_by: str | list[str] | None = None,
                          partition_by: list[str] | None = None, n_blocks: int | None = None) -> DataFrame:
    """Forward fill then backward fill, per column, in row order.

    Without ``partition_by`` the order is global; it is computed blockwise
    (``ordered.ffill_bfill``), never in one task. With ``partition_by`` each
    group is filled on its own, still split into blocks so a hot group is not
    one task.
    """
    df, order, helpers = order_column(df, order_by)
    skip = set(helpers) | set(partition_by or []) | ({order_by} if isinstance(order_by, str) else set(order_by or []))
    cols = columns if columns is not None else [c for c in df.columns if c not in skip]
    out = ffill_bfill(df, cols, order, partition_by=partition_by, n_blocks=n_blocks)
    return out.drop(*helpers) if helpers else out


# --------------------------------------------------------------------- C7
def standard_scale(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x - mean) / population sd; sd 0 counts as 1; missing ignored in the fit.

    One aggregate; MLlib's StandardScaler uses the sample sd, so it is not used.
    """
    df = nan_to_null(df)
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return df
    row = df.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(qcol(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            m, s = row[f"m{i}"], row[f"s{i}"]
            if m is None:
                out.append(qcol(c).cast("double").alias(c))
                continue
            s = 1.0 if (s is None or s == 0 or math.isnan(s)) else s
            out.append(((qcol(c) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


__all__ = [
    "drop_missing", "three_sigma", "sigma_bounds", "impute", "fill_values", "apply_fill",
    "text_fill", "dedupe", "fill_forward_backward", "standard_scale", "nan_to_null",
]
