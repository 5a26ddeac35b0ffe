"""A4: record-batch sources -- rows whose keys differ; absent keys become null."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import nan_to_null, qcol


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines records; the reader merges the keys of all rows into one schema."""
    return nan_to_null(spark.read.json(path))


def records_schema(df: DataFrame, column: str) -> str:
    """Merged schema of a JSON text column, from one distributed aggregate.

    Keys whose values differ in type across rows come back as VARIANT and are
    read as their JSON text (pandas would hold mixed objects); fractional
    numbers are doubles, as pandas reads them.
    """
    variant_schema = df.select(F.schema_of_variant_agg(F.parse_json(qcol(column))).alias("s")).first()["s"]
    ddl = variant_schema.replace("OBJECT<", "STRUCT<")
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", ddl)
    return re.sub(r"\bVARIANT\b", "STRING", ddl)


def parse_records(df: DataFrame, column: str, schema: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Expand a JSON text column into typed columns (union of keys across rows).

    Without ``schema`` the key union is inferred by ``schema_of_variant_agg``
    (partial aggregate; only the schema string reaches the driver).
    """
    schema = schema or records_schema(df, column)
    parsed = F.from_json(qcol(column), schema)
    keep_cols = keep if keep is not None else [c for c in df.columns if c != column]
    return df.select(*[qcol(c) for c in keep_cols], parsed.alias("_rec")).select(*keep_cols, "_rec.*")
