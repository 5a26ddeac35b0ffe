"""Sensor-window features: I1 for one frame, I2 for every window of every device."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import nan_to_null, numeric_columns, qcol


def _mean_skip_null(cols: list[Column]) -> Column:
    arr = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def _feature_aggs(columns: list[str]) -> list[Column]:
    aggs = []
    for i, c in enumerate(columns):
        x = qcol(c).cast("double")
        aggs += [F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.max(x).alias(f"_hi{i}"), F.min(x).alias(f"_lo{i}")]
    return aggs


def _feature_cols(columns: list[str]) -> list[Column]:
    n = range(len(columns))
    mean_all = _mean_skip_null([F.col(f"_m{i}") for i in n])
    return [mean_all.alias("mean_all"),
            _mean_skip_null([F.col(f"_s{i}") for i in n]).alias("std_all"),
            F.greatest(*[F.col(f"_hi{i}") for i in n]).alias("max_all") if len(columns) > 1 else F.col("_hi0").alias("max_all"),
            F.least(*[F.col(f"_lo{i}") for i in n]).alias("min_all") if len(columns) > 1 else F.col("_lo0").alias("min_all"),
            mean_all.alias("mean_of_means")]


def sensor_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row -- mean of column means, mean of column sample sd, overall
    max, overall min, and ``mean_of_means`` (equal to ``mean_all``, kept for
    the reference's layout). Means of means, not cell means."""
    df = nan_to_null(df)
    cols = columns if columns is not None else numeric_columns(df)
    return df.agg(*_feature_aggs(cols)).select(*_feature_cols(cols))


def sensor_windows(df: DataFrame, ts_col: str, size: str, slide: str | None = None,
                   device_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """I1 per (time window, device). Tumbling when ``slide`` is None.

    One grouped aggregate with partial aggregation: a device with a third of
    all rows is spread over its windows and pre-aggregated map-side.

    Sliding windows of a batch are put together from panes (``_sliding``): each row is
    summed up once, however many windows it is in. A stream keeps Spark's sliding window.
    """
    df = nan_to_null(df)
    skip = {ts_col, device_col}
    cols = columns if columns is not None else [c for c in numeric_columns(df) if c not in skip]
    if slide and not df.isStreaming:
        return _sliding(df, ts_col, size, slide, device_col, cols)
    w = F.window(qcol(ts_col), size, slide) if slide else F.window(qcol(ts_col), size)
    keys = [w.alias("window")] + ([qcol(device_col)] if device_col else [])
    out = df.groupBy(*keys).agg(*_feature_aggs(cols))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      *([device_col] if device_col else []), *_feature_cols(cols))


def _micros(df: DataFrame, interval: str) -> int:
    return df.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {interval})")).first()[0]


def _sliding(df: DataFrame, ts_col: str, size: str, slide: str, device_col: str | None, cols: list[str]) -> DataFrame:
    """Sliding windows from panes as wide as the greatest common divisor of size and slide.

    A pane's count, mean, squared deviations, maximum and minimum per column merge into
    those of a window: the rows are aggregated to panes (one exchange), and only panes go
    to the windows they lie in. The merge takes deviations from the panes' means, so it is
    as exact as one pass over the rows."""
    width, step = _micros(df, size), _micros(df, slide)
    pane = math.gcd(width, step)
    at = qcol(ts_col)
    kind = df.schema[ts_col].dataType
    micros = F.unix_micros(at.cast("timestamp"))
    device = [qcol(device_col)] if device_col else []
    key = micros - F.pmod(micros, F.lit(pane))
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), (F.var_pop(x) * F.count(x)).alias(f"q{i}"), F.max(x).alias(f"h{i}"), F.min(x).alias(f"l{i}")]
    panes = df.filter(at.isNotNull()).groupBy(key.alias("_pane"), *device).agg(*aggs)
    # windows start at multiples of the slide; a pane lies in those that start in (its end - size, its start]
    start = F.col("_pane")
    last = start - F.pmod(start, F.lit(step))
    spread = panes.withColumn("_start", F.explode(F.filter(
        F.transform(F.sequence(F.lit(0), F.lit((width - 1) // step)), lambda k: last - k.cast("long") * step), lambda s: s + width >= start + pane)))
    merged = []
    for i, _ in enumerate(cols):
        n, a = F.col(f"n{i}"), F.col(f"a{i}")
        merged += [F.sum(n).alias(f"n{i}"), (F.sum(n * a) / F.nullif(F.sum(n), F.lit(0))).alias(f"_m{i}"), F.max(f"h{i}").alias(f"_hi{i}"), F.min(f"l{i}").alias(f"_lo{i}"),
                   # squared deviations inside the panes, and of the panes' means
                   F.sum(F.col(f"q{i}")).alias(f"q{i}"), F.collect_list(F.when(n > 0, F.struct(n.alias("n"), a.alias("a")))).alias(f"p{i}")]
    windows = spread.groupBy("_start", *device).agg(*merged)
    for i, _ in enumerate(cols):
        between = F.expr(f"aggregate(p{i}, 0D, (t, p) -> t + p.n * (p.a - _m{i}) * (p.a - _m{i}))")
        windows = windows.withColumn(f"_s{i}", F.when(F.col(f"n{i}") > 1, F.sqrt((F.col(f"q{i}") + between) / (F.col(f"n{i}") - 1))))
    when = lambda m: F.timestamp_micros(m).cast(kind)
    return windows.select(when(F.col("_start")).alias("window_start"), when(F.col("_start") + width).alias("window_end"),
                          *([device_col] if device_col else []), *_feature_cols(cols))
