"""Size-checked broadcast: broadcast a side only when its row count is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only under this many rows, checked by a count first.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``
    (a shuffle join). The count reads at most ``max_rows + 1`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
