"""J1 clean per micro-batch, J2 windowed sensor features with a watermark,
J3 audit log sink, J4 scoring a stream, J5 dedupe within a watermark.

The reference cleans, scores and logs at request time; a Spark user runs the
same operators on a stream. Every writer takes a checkpoint location in the
shared checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.kinds import numeric_columns, qcol
from ..operators.clean import dedupe, fill_forward_backward, nan_to_null, within_bounds
from ..operators.models import predict
from ..operators.sensors import _feature_aggs, _feature_cols
from ..plans.cleaning import clean_records
from ..session import write_scratch
from ..sources.audit import audit_rows


def file_stream(spark: SparkSession, path_glob: str, schema, fmt: str = "parquet", base_path: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream (new files in a folder become micro-batches)."""
    r = spark.readStream.schema(schema).format(fmt)
    if base_path:
        r = r.option("basePath", base_path)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path_glob)


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """``withWatermark`` rejects TIMESTAMP_NTZ, so it becomes a TIMESTAMP whose
    instant is the wall clock read as UTC -- whatever the session time zone,
    day windows then start at wall-clock midnight, as on the NTZ value."""
    if df.schema[ts_col].dataType.typeName() == "timestamp_ntz":
        return df.withColumn(ts_col, F.from_utc_timestamp(qcol(ts_col).cast("timestamp"), _session_tz(df)))
    return df


def wall_clock(c, df: DataFrame):
    """Inverse of ``event_time`` for output columns: TIMESTAMP back to the NTZ wall clock."""
    return F.to_utc_timestamp(c, _session_tz(df)).cast("timestamp_ntz")


# --------------------------------------------------------------------- J1
def clean_stream(stream: DataFrame, sink_path: str, checkpoint: str, order_by: str | None = None,
                 k: float = 3.0, fmt: str = "parquet", bounds: dict | None = None,
                 available_now: bool = True, order_is_position: bool = False) -> StreamingQuery:
    """Run C6 ``clean_records`` on every micro-batch. Each epoch overwrites its own
    ``_epoch=`` folder of the sink, so a batch that is replayed after a failure adds no rows.

    Statistics are per batch, as the reference computes them per request, or
    frozen: pass ``bounds`` from ``sigma_bounds`` on a batch reference table.
    """

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # read several times below
        cleaned = clean_records(batch, order_by=order_by, k=k, bounds=bounds, order_is_position=order_is_position)
        cleaned.write.mode("overwrite").format(fmt).save(f"{sink_path.rstrip('/')}/_epoch={epoch_id}")
        batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _earlier(spark: SparkSession, path: str, epoch_id: int) -> DataFrame | None:
    """What epochs before this one have stored under ``path`` (None: nothing yet)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return None
    return spark.read.parquet(path).where(F.col("_epoch") < epoch_id)


def _row_print(columns: list[str]):
    """128 bits of a whole row; a null is not the same as a value left out."""
    cells = [x for c in columns for x in (qcol(c).isNull(), qcol(c))]
    return F.struct(F.xxhash64(F.lit(1), *cells).alias("a"), F.xxhash64(F.lit(2), *cells).alias("b"))


def merge_moments(n: int, mean: float, m2: float, n2: int, mean2: float, m22: float) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of two parts together."""
    total = n + n2
    if not total:
        return 0, 0.0, 0.0
    delta = mean2 - mean
    return total, mean + delta * n2 / total, m2 + m22 + delta * delta * n * n2 / total


class StatefulCleaner:
    """J1 with memory: what one micro-batch learns, the next one uses.

    Three things are kept under ``state_path``, one folder per epoch:

    - ``seen``: 128-bit prints of the kept rows' data columns, so a row that came in an
      earlier batch is dropped. They grow with the distinct rows; ``remember`` keeps
      to those of so many epochs.
    - ``carry``: the last row in order of all rows so far, filled, as the first row the
      next batch fills from (one row an epoch).
    - ``moments``: count, mean and squared deviations of each number column over all
      filled rows so far (one row a column), which give the 3-sigma bounds of a batch,
      its own rows included. ``k=None`` leaves the filter out.

    An epoch reads earlier epochs only and overwrites its own folders, state before rows,
    so a batch that is replayed after a failure gives the same rows and the same state.

    Defined results: rows that arrive later than their order says are filled from the rows
    before them in their own batch, or the carried row if it comes before; a gap before
    the first value of a column takes the first value of its batch, and stays null if
    that has none. Missing order keys come first. Repeats within a batch keep the
    smallest order key. An empty batch changes nothing.
    """

    def __init__(self, sink_path: str, state_path: str, order_by: str, k: float | None = 3.0, fmt: str = "parquet",
                 remember: int | None = None):
        self.sink, self.state = sink_path.rstrip("/"), state_path.rstrip("/")
        self.order_by, self.k, self.fmt, self.remember = order_by, k, fmt, remember

    def _write(self, df: DataFrame, what: str, epoch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.state}/{what}/_epoch={epoch_id}")

    def new_rows(self, batch: DataFrame, epoch_id: int) -> DataFrame:
        """The batch without repeats, within it or of earlier epochs."""
        data = [c for c in batch.columns if c != self.order_by]
        rows = dedupe(nan_to_null(batch), order_by=self.order_by, order_is_position=True).withColumn("_print", _row_print(data))
        seen = _earlier(batch.sparkSession, f"{self.state}/seen", epoch_id)
        if seen is not None:
            if self.remember is not None:
                seen = seen.where(F.col("_epoch") >= epoch_id - self.remember)
            rows = rows.join(seen.select(F.struct("a", "b").alias("_print")), "_print", "left_anti")
        return write_scratch(rows, "stream-new")  # read twice below

    def filled_rows(self, rows: DataFrame, epoch_id: int) -> DataFrame:
        """``rows`` and the carried row (``_carried``), filled in order."""
        carry = _earlier(rows.sparkSession, f"{self.state}/carry", epoch_id)
        rows = rows.drop("_print").withColumn("_carried", F.lit(False))
        if carry is not None:
            last = carry.orderBy(F.col("_epoch").desc()).limit(1).drop("_epoch").withColumn("_carried", F.lit(True))
            rows = rows.unionByName(last)
        data = [c for c in rows.columns if c not in (self.order_by, "_carried")]
        return write_scratch(fill_forward_backward(rows, data, order_by=self.order_by), "stream-filled")

    def bounds(self, filled: DataFrame, epoch_id: int) -> dict[str, tuple[float | None, float | None]]:
        """Bounds from all epochs up to this one; stores their moments. One row a column, schema-sized."""
        spark, cols = filled.sparkSession, numeric_columns(filled, exclude=[self.order_by])
        earlier = _earlier(spark, f"{self.state}/moments", epoch_id)
        known = {}
        if earlier is not None:
            newest = earlier.groupBy("column").agg(F.max_by(F.struct("n", "mean", "m2"), "_epoch").alias("m"))
            known = {r["column"]: tuple(r["m"]) for r in newest.collect()}
        rows = filled.where("not _carried").agg(*[x for i, c in enumerate(cols) for x in (
            F.count(qcol(c)).alias(f"n{i}"), F.avg(qcol(c)).alias(f"a{i}"), F.var_pop(qcol(c)).alias(f"v{i}"))]).first() if cols else None
        out, state = {}, []
        for i, c in enumerate(cols):
            n = rows[f"n{i}"]
            n, mean, m2 = merge_moments(*known.get(c, (0, 0.0, 0.0)), n, float(rows[f"a{i}"] or 0), float(rows[f"v{i}"] or 0) * n)
            state.append((c, n, mean, m2))
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else None
            out[c] = (None, None) if sd is None else (mean - self.k * sd, mean + self.k * sd)
        self._write(spark.createDataFrame(state, "column string, n long, mean double, m2 double"), "moments", epoch_id)
        return out

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        rows = self.new_rows(batch, epoch_id)
        filled = self.filled_rows(rows, epoch_id)
        bounds = self.bounds(filled, epoch_id) if self.k is not None else {}
        self._write(rows.select("_print.a", "_print.b"), "seen", epoch_id)
        self._write(filled.orderBy(qcol(self.order_by).desc_nulls_last()).limit(1).drop("_carried"), "carry", epoch_id)
        kept = filled.where("not _carried").drop("_carried")
        for c, (lo, hi) in bounds.items():
            kept = kept.where(within_bounds(c, lo, hi))
        kept.write.mode("overwrite").format(self.fmt).save(f"{self.sink}/_epoch={epoch_id}")


def clean_stream_stateful(stream: DataFrame, sink_path: str, state_path: str, checkpoint: str, order_by: str,
                          k: float | None = 3.0, fmt: str = "parquet", remember: int | None = None,
                          available_now: bool = True) -> StreamingQuery:
    """A stream cleaned as one table (``StatefulCleaner``): repeats of earlier batches go,
    gaps are filled over batches, bounds come from all rows so far."""
    w = stream.writeStream.foreachBatch(StatefulCleaner(sink_path, state_path, order_by, k, fmt, remember))
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


# --------------------------------------------------------------------- J2
def window_features_stream(stream: DataFrame, ts_col: str, size: str, slide: str | None = None,
                           device_col: str | None = None, columns: list[str] | None = None,
                           watermark: str = "1 hour") -> DataFrame:
    """I1 features per (window, device) on a stream. Rows later than the
    watermark are dropped; in append mode a window is emitted once closed."""
    s = event_time(stream, ts_col).withWatermark(ts_col, watermark)
    cols = columns or [c for c in numeric_columns(s) if c not in (ts_col, device_col)]
    w = F.window(qcol(ts_col), size, slide) if slide else F.window(qcol(ts_col), size)
    keys = [w.alias("window")] + ([qcol(device_col)] if device_col else [])
    out = s.groupBy(*keys).agg(*_feature_aggs(cols))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      *([device_col] if device_col else []), *_feature_cols(cols))


# --------------------------------------------------------------------- J3
def audit_stream(stream: DataFrame, path: str, checkpoint: str, action_col: str, ts_col: str | None = None,
                 detail_cols: list[str] | None = None) -> StreamingQuery:
    """Append every event to the JSON-lines audit log."""
    rows = audit_rows(stream, action_col=action_col, ts_col=ts_col, detail_cols=detail_cols)
    return (rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


# --------------------------------------------------------------------- J4
def score_stream(stream: DataFrame, model) -> DataFrame:
    """Score a stream with a fitted model -- an MLlib ``PipelineModel`` (by ``predict``:
    a row per row, null scores where a feature is missing) or the isolation forest."""
    if hasattr(model, "score") and hasattr(model, "nodes"):
        return model.score(stream)
    return predict(model, stream)


# --------------------------------------------------------------------- J5
def dedupe_stream(stream: DataFrame, keys: list[str], ts_col: str, watermark: str) -> DataFrame:
    """Drop repeats of ``keys`` seen within the watermark delay; state
    for a key is dropped once the watermark passes it."""
    return event_time(stream, ts_col).withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(keys)


def run_to_table(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
                 fmt: str = "parquet") -> StreamingQuery:
    """Drain every available input into a file sink (append) or, for complete
    mode, overwrite the folder each batch; returns the finished query."""
    if mode == "append":
        q = (df.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        def write(batch: DataFrame, epoch_id: int) -> None:
            batch.write.mode("overwrite").format(fmt).save(sink_path)
        q = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
