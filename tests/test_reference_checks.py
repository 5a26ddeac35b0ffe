"""The reference's own four operator tests, as Spark tests."""

import os

import pandas as pd
from pyspark.sql import functions as F

from prepark.operators.clean import impute
from prepark.operators.columns import trim_columns
from prepark.sources.files import read_table, write_table


def test_padded_name_is_trimmed(spark):
    df = spark.createDataFrame(pd.DataFrame({" A ": [1, 2]}))
    assert trim_columns(df).columns == ["A"]


def test_impute_leaves_no_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "y")], "a double, b string")
    rows = impute(df).orderBy(F.col("a")).collect()
    assert [r["a"] for r in rows] == [1.0, 2.0, 3.0]
    assert sorted(r["b"] for r in rows) == ["missing", "x", "y"]


def test_csv_text_shape(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1,2\n3,4\n")
    df = read_table(spark, str(p))
    assert (df.count(), len(df.columns)) == (2, 2)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "bigint"]


def test_saved_copy_exists(spark, tmp_path):
    df = spark.createDataFrame([(1, 3), (2, 4)], "x int, y int")
    out = write_table(df, str(tmp_path / "copy"), fmt="csv")
    assert os.path.isdir(out)
    assert read_table(spark, out, fmt="csv").count() == 2
