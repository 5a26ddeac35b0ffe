"""C3 clean_table (file clean, the flagship) and C6 clean_records (online clean)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import missing, numeric_columns, order_column, qcol
from ..operators.clean import within_bounds, apply_fill, dedupe, fill_values, three_sigma
from ..operators.columns import trim_columns
from ..operators.ordered import block_splits, ffill_bfill
from ..session import materialize, write_scratch
from ..sources.files import read_table


def clean_table(df: DataFrame, strategy: dict | None = None, approx: bool = False,
                compat: bool = False) -> tuple[DataFrame, dict]:
    """Trim names -> "before" stats -> impute -> "after" stats.

    The "before" missing counts and the fill values come from the same
    aggregate pass (plus one distributed median job); "after" follows from
    them -- a filled column has no missing cells left, a column whose fill is
    undefined (all missing) keeps its count -- so there is no second scan.
    """
    df = trim_columns(df)
    plan = fill_values(df, strategy, approx, compat)
    cleaned = apply_fill(df, plan, compat)
    before = {"rows": plan["rows"], "cols": len(df.columns), "missing": dict(plan["missing"])}
    after_missing = {}
    for c, n in plan["missing"].items():
        v = plan["fill"].get(c)
        filled = v is not None and not (isinstance(v, tuple) and v[1] is None)
        after_missing[c] = 0 if (filled or n == 0) else n
    after = {"rows": plan["rows"], "cols": len(df.columns), "missing": after_missing}
    return cleaned, {"before": before, "after": after}


def meta_frame(spark: SparkSession, meta: dict) -> DataFrame:
    """The clean metadata as a small frame ``(stage, rows, cols, missing map)``."""
    rows = [(stage, m["rows"], m["cols"], m["missing"]) for stage, m in meta.items()]
    return spark.createDataFrame(rows, "stage string, rows bigint, cols int, missing map<string,bigint>")


def clean_file(spark: SparkSession, path: str, read: dict | None = None, **kw) -> tuple[DataFrame, dict]:
    """C3 from a file path: A1 scan (``read``: its options), then ``clean_table``."""
    return clean_table(read_table(spark, path, **(read or {})), **kw)


def clean_records(df: DataFrame, order_by: str | list[str] | None = None, k: float = 3.0,
                  mode: str = "sequential", checkpoint: bool = True,
                  bounds: dict[str, tuple[float | None, float | None]] | None = None,
                  order_is_position: bool = False) -> DataFrame:
    """Dedupe (keep first) -> forward/backward fill -> 3-sigma filter.

    Returns the cleaned rows with the order column (first position of each
    kept row). The filled frame is written once as a parquet table in the
    shared checkpoint folder before the k per-column sigma passes, so they do
    not recompute the dedupe shuffle and the fill windows, and each reads
    only the columns it filters on. ``bounds`` (from ``sigma_bounds`` on
    a reference table) freezes the filter instead: no statistics pass at all.
    """
    # block edges from the input's order key: the kept rows' keys are a subset of
    # them, so the dedupe shuffle is not run a second time just to find edges
    df_o, in_order, _ = order_column(df, order_by)
    splits = block_splits(df_o, in_order)
    deduped = dedupe(df, order_by=order_by, order_is_position=order_is_position)
    order_name = order_by if isinstance(order_by, str) else "_order"
    deduped, order, _ = order_column(deduped, order_name)
    value_cols = [c for c in deduped.columns if c != order_name]
    filled = ffill_bfill(deduped, value_cols, order, splits=splits)
    if bounds is not None:
        cond = F.lit(True)
        for c, (lo, hi) in bounds.items():
            cond = cond & (within_bounds(c, lo, hi))
        return filled.where(cond)
    if checkpoint:
        # a parquet table, not a checkpoint: each sigma pass then reads only its columns
        filled = write_scratch(filled, "clean-records")
    return three_sigma(filled, numeric_columns(filled, exclude=[order_name]), k=k, mode=mode)


def clean_records_summary(cleaned: DataFrame) -> DataFrame:
    """C6 response numbers in one aggregate: ``(rows, total_missing)``."""
    total = F.lit(0).cast("bigint")
    for f in cleaned.schema.fields:
        total = total + missing(qcol(f.name), f.dataType).cast("bigint")
    return cleaned.agg(F.count(F.lit(1)).alias("rows"),
                       F.coalesce(F.sum(total), F.lit(0).cast("bigint")).alias("total_missing"))


def clean_upload(df: DataFrame, order_by: str | list[str] | None = None, preview_rows: int = 10,
                 **kw) -> tuple[DataFrame, DataFrame]:
    """C6 upload response: ``(rows frame, first rows)`` of the cleaned table.

    The cleaned frame is checkpointed once, so the count and the preview do
    not clean twice.
    """
    from ..sources.files import preview
    cleaned = materialize(clean_records(df, order_by=order_by, **kw))
    order_name = order_by if isinstance(order_by, str) else "_order"
    return (cleaned.agg(F.count(F.lit(1)).alias("rows")),
            preview(cleaned, preview_rows, order_by=order_name if order_name in cleaned.columns else None))
