"""Column-level table operators: B1 trim names, B2 target rename, B4 numeric projection, B5 drop."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.kinds import numeric_columns, qcol
from ..functions.patterns import TARGET_CANDIDATES


def trim_columns(df: DataFrame) -> DataFrame:
    """B1: strip surrounding whitespace from column names.

    pandas allows two columns to end up with the same name; Spark would then
    fail to resolve either, so a clash is an error here.
    """
    names = [str(c).strip() for c in df.columns]
    seen = set()
    dupes = sorted({n for n in names if n in seen or seen.add(n)})
    if dupes:
        raise ValueError(f"column names collide after trimming: {dupes}")
    return df.toDF(*names)


def rename_target(df: DataFrame, target: str = "target", source: str = "outcome",
                  case_insensitive: bool = True) -> DataFrame:
    """B2: rename ``Outcome`` to ``target`` when ``target`` is absent; the
    match ignores case unless ``case_insensitive=False`` (then ``source`` must
    match exactly, e.g. ``"Outcome"``)."""
    if target in df.columns:
        return df
    for c in df.columns:
        if (c.lower() == source.lower()) if case_insensitive else (c == source):
            return df.withColumnRenamed(c, target)
    return df


def resolve_target(df: DataFrame, target: str | None) -> str:
    """Exact name, else a case-insensitive match, else a known candidate name."""
    cols = df.columns
    if target and target in cols:
        return target
    if target:
        for c in cols:
            if c.lower() == target.lower():
                return c
    lowered = {c.lower(): c for c in cols}
    for cand in TARGET_CANDIDATES:
        if cand in lowered:
            return lowered[cand]
    raise ValueError(f"target column '{target}' not found; columns: {cols}")


def numeric_projection(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Keep number columns only (boolean is not a number)."""
    return df.select(*[qcol(c) for c in numeric_columns(df, exclude)])


def drop_target(df: DataFrame, target: str) -> DataFrame:
    """Drop the target column (error if absent)."""
    if target not in df.columns:
        raise ValueError(f"nothing to drop: the table has no column {target!r}")
    return df.drop(target)
