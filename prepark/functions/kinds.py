"""Column kinds, missing-value normalisation and row-order keys.

pandas decides per column whether it is numeric, text, boolean or a
timestamp; these helpers answer the same question from ``df.schema`` alone, so
no data is scanned to plan an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens pandas' CSV reader turns into a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

ORDER_COL = "_order"


def is_numeric(dt: T.DataType) -> bool:
    """Number types; boolean is not a number (as in numpy's ``issubdtype``)."""
    return isinstance(dt, T.NumericType)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Numeric-column projection, in schema order."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType) and f.name not in exclude]


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric(dt):
        return "numeric"
    if is_temporal(dt):
        return "datetime"
    if is_text(dt):
        return "text"
    return "other"


def as_text(c: str, dt: T.DataType) -> Column:
    """A cell as text; 0.0 and -0.0 are one value, as in pandas."""
    x = qcol(c)
    return (x + F.lit(0.0) if isinstance(dt, (T.FloatType, T.DoubleType)) else x).cast("string")


def missing(c: str | Column, dt: T.DataType | None = None) -> Column:
    """Predicate for a missing cell: null, or NaN in a float column."""
    col = qcol(c) if isinstance(c, str) else c
    if dt is not None and isinstance(dt, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to null in float columns so every operator can assume null only."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        (F.when(F.isnan(qcol(c)), F.lit(None)).otherwise(qcol(c)).alias(c) if c in floats else qcol(c))
        for c in df.columns
    ])


def path_not_found(e: Exception) -> bool:
    """Whether a read failed because nothing is at the path."""
    return any(s in str(e) for s in ("PATH_NOT_FOUND", "Input path does not exist", "FileNotFoundException"))


def qcol(name: str) -> Column:
    """Column by exact name, safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


# rows per partition fit in the low bits of monotonically_increasing_id
_ROW_BITS = 33


def with_file_order(df: DataFrame, name: str = ORDER_COL) -> DataFrame:
    """Attach the row order of a file source as one sortable ``bigint``.

    ``monotonically_increasing_id`` alone follows partition numbering, which
    does not follow file order when small files are packed together. Here each
    input split (file, start offset) gets its ordinal in (file, offset) order
    from a small table -- one row per split, bounded by the scan's partition
    count and checked before it is broadcast -- and the key is
    ``ordinal * 2^33 + row within the partition``. A single ``bigint`` keeps
    every ``min``/``max`` over it a hash aggregate.
    Frames that do not come from files (in-memory, ``range``) keep their
    partition order.
    """
    try:
        df.select("_metadata.file_path").schema
    except Exception:  # noqa: BLE001 - not a file source
        return df.withColumn(name, F.monotonically_increasing_id())
    from pyspark.sql import Window

    from ..operators.joins import maybe_broadcast

    meta = df.select(F.col("_metadata.file_path").alias("_of"), F.col("_metadata.file_block_start").alias("_ob"))
    splits = meta.distinct()
    ordinal = splits.withColumn("_split", F.row_number().over(Window.orderBy("_of", "_ob")) - 1)
    # the row id is taken in the scan's own partitions, before any join can move rows
    tagged = (df.withColumn("_of", F.col("_metadata.file_path")).withColumn("_ob", F.col("_metadata.file_block_start"))
              .withColumn("_orow", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
              .join(maybe_broadcast(ordinal, 5_000_000), on=["_of", "_ob"]))
    return (tagged.withColumn(name, F.col("_split") * F.lit(1 << _ROW_BITS) + F.col("_orow"))
            .drop("_of", "_ob", "_split", "_orow"))


def _as_long(c: Column, dt: T.DataType) -> Column | None:
    if is_integral(dt):
        return c.cast("bigint")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("bigint")
    return None


def packed_order(df: DataFrame, columns: list[str]) -> Column | None:
    """One number ordered like ``struct(columns)`` (nulls first), or None.

    Works when every column is integral or a time: one min/max aggregate over
    those columns gives each range, and the offsets are packed into a
    ``bigint`` (<= 63 bits) or a ``decimal(38,0)`` (<= 126 bits). A single
    number keeps every min/max over the order a hash aggregate; a struct key
    would make them sort-based.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    longs = [_as_long(qcol(c), types[c]) for c in columns]
    if any(x is None for x in longs):
        return None
    row = df.agg(*[F.min(x).alias(f"lo{i}") for i, x in enumerate(longs)],
                 *[F.max(x).alias(f"hi{i}") for i, x in enumerate(longs)]).first()
    widths = []
    for i in range(len(columns)):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        span = 0 if lo is None else hi - lo + 1
        widths.append(max(1, (span + 1).bit_length()))  # +1: value 0 is kept for null
    total = sum(widths)
    if total > 126:
        return None
    kind = "bigint" if total <= 63 else "decimal(38,0)"
    packed, shift = None, total
    for i, x in enumerate(longs):
        shift -= widths[i]
        lo = row[f"lo{i}"] or 0
        factor = F.lit(str(1 << shift)).cast(kind)  # text: the factor may exceed 64 bits
        # offsets in the target type: a column's range may not fit a bigint difference
        offset = x.cast(kind) - F.lit(str(lo)).cast(kind) + F.lit(1).cast(kind)
        part = F.coalesce(offset, F.lit(0).cast(kind)) * factor
        packed = part if packed is None else packed + part
    return packed.cast(kind)


def order_column(df: DataFrame, order_by: str | list[str] | None) -> tuple[DataFrame, Column, list[str]]:
    """Resolve an ``order_by`` argument into one sortable column.

    Returns the frame (with an order column added when needed), the order
    expression and the names of helper columns to drop at the end. No order
    means file order; several columns are packed into one number when they are
    integral or times, else kept as a struct.
    """
    if order_by is None:
        if ORDER_COL in df.columns:
            return df, F.col(ORDER_COL), []
        return with_file_order(df), F.col(ORDER_COL), [ORDER_COL]
    if isinstance(order_by, str):
        return df, qcol(order_by), []
    if len(order_by) == 1:
        return df, qcol(order_by[0]), []
    packed = packed_order(df, list(order_by))
    if packed is not None:
        return df.withColumn(ORDER_COL, packed), F.col(ORDER_COL), [ORDER_COL]
    return df, F.struct(*[qcol(c) for c in order_by]), []
