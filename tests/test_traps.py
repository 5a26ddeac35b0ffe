"""Trap fixtures of SURVEY section 2 / FIXTURES section 3."""

import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepark.functions.kinds import nan_to_null
from prepark.operators import clean as C
from prepark.operators import profile as P
from prepark.operators import recommend as G
from prepark.operators import routes as H
from prepark.plans.cleaning import clean_table
from prepark.sources.files import read_table, safe_output_name


def test_na_tokens_and_bom(spark, tmp_path):
    p = tmp_path / "na.csv"
    p.write_bytes("﻿id,n\n1,NA\n2,n/a\n3,NULL\n4,\n5,7\n".encode("utf-8"))
    df = read_table(spark, str(p))
    assert df.columns == ["id", "n"]
    assert df.schema["n"].dataType.simpleString() == "bigint"
    assert df.where(F.col("n").isNull()).count() == 4


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, float("nan"), None, 4.0]}))
    got = {r["column"]: r["n_missing"] for r in P.summary_stats(df).collect()}
    assert got == {"x": 2}
    assert nan_to_null(df).where(F.col("x").isNull()).count() == 2


def test_all_null_numeric_stays_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "c double, d double")
    out, meta = clean_table(df)
    assert out.where(F.col("c").isNull()).count() == 2
    assert meta["after"]["missing"]["c"] == 2 and meta["after"]["missing"]["d"] == 0
    # D7b does not list an all-missing column
    assert [r["column"] for r in P.binary_targets(df).collect()] == []


def test_constant_column_drops_every_row(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "a double")
    assert C.three_sigma(df).count() == 0


def test_single_row_drops(spark):
    df = spark.createDataFrame([(5.0,)], "a double")
    assert C.three_sigma(df).count() == 0


def test_even_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "v double")
    vals = sorted(r["v"] for r in C.impute(df).collect())
    assert vals == [1.0, 2.0, 3.0, 4.0, 9.0]


def test_integer_with_gap_becomes_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v bigint")
    out = C.impute(df)
    assert out.schema["v"].dataType.simpleString() == "double"
    assert sorted(r["v"] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_leading_gap_fill(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, 2.0), (4, None)], "i int, v double")
    out = C.fill_forward_backward(df, ["v"], order_by="i", n_blocks=3)
    assert [r["v"] for r in out.orderBy("i").collect()] == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert C.dedupe(df, keep_order=False).count() == 2
    assert C.dedupe(df).count() == 2


def test_roles_paid_and_year(spark):
    df = spark.createDataFrame([(i, 2000 + i % 3, "t") for i in range(60)], "paid int, year int, note string")
    roles = {r["column"]: r["role"] for r in P.field_roles(df).collect()}
    assert roles == {"paid": "id", "year": "numeric", "note": "categorical"}


def test_repeated_edge_keeps_last(spark):
    e = spark.createDataFrame([(0, "A", "B", 5.0), (1, "A", "B", 2.0)], "o int, source string, target string, weight double")
    g = H.build_graph(e, order_by="o").collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in g] == [("A", "B", 2.0)]


def test_missing_weight_column_defaults_to_one(spark):
    e = spark.createDataFrame([("A", "B")], "source string, target string")
    assert H.build_graph(e).first()["weight"] == 1.0


def test_route_sample_and_cycles(spark):
    e = spark.createDataFrame([("A", "B", 5), ("B", "C", 3), ("A", "C", 10), ("C", "D", 1)],
                              "source string, target string, weight int")
    r = H.shortest_route(H.build_graph(e), "A", "D").first()
    assert r["path"] == ["A", "B", "C", "D"] and r["length"] == 9.0
    cyc = H.build_graph(spark.createDataFrame([("A", "B", 1), ("B", "A", 1), ("C", "D", 1)],
                                              "source string, target string, weight int"))
    assert H.shortest_route(cyc, "A", "B").first()["path"] == ["A", "B"]
    with pytest.raises(ValueError):
        H.shortest_route(cyc, "A", "D")
    with pytest.raises(KeyError):
        H.shortest_route(cyc, "A", "Z")


def test_zero_vector_similarity(spark):
    wide = spark.createDataFrame([("u1", 1.0, 0.0), ("u2", 0.0, 0.0), ("u3", 2.0, 1.0)], "k string, i1 double, i2 double")
    ratings = G.matrix_long(wide, "k", drop_zeros=False)
    sims = {r["user"]: r["similarity"] for r in G.user_similarity(ratings, "u1").collect()}
    assert sims["u2"] == 0.0 and math.isclose(sims["u1"], 1.0)
    zero = {r["user"]: r["similarity"] for r in G.user_similarity(ratings, "u2").collect()}
    assert set(zero.values()) == {0.0}
    with pytest.raises(KeyError):
        G.user_similarity(ratings, "nobody")


def test_safe_output_name():
    now = datetime(2024, 1, 2, 3, 4, 5)
    assert safe_output_name("my data?.xlsx", now) == "my data__20240102_030405.csv"
    assert safe_output_name("report.txt", now) == "report_20240102_030405.csv"


def test_describe_text_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    r = P.describe_text(df).first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (5, 3, "a", 2)


def test_describe_text_long_ties_and_all_unique(spark):
    a, b = "b" * 100, "a" * 100
    df = spark.createDataFrame([(a,), (b,), (a,), (b,), ("zz",)], "t string")
    r = P.describe_text(df).first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (5, 3, b, 2)
    uniq = spark.createDataFrame([("y" * 80,), ("x" * 90,), ("q",)], "t string")
    r = P.describe_text(uniq).first()
    assert (r["unique"], r["top"], r["freq"]) == (3, "q", 1)


def test_pii_number_text_is_plain(spark):
    from prepark.operators import pii as E
    df = spark.createDataFrame([(1, 12345678.5), (2, 10000000.0), (3, 1.25)], "i int, x double")
    rows = df.select("i", E._text_of(F.col("x"), df.schema["x"].dataType).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == ["12345678.5", "10000000.0", "1.25"]
    # compat scans numbers too: an 8-digit number counts as a phone pattern, as in the reference
    got = E.pii_detect(df, order_by="i", compat=True).collect()
    assert [(r["column"], r["count_examples"]) for r in got if r["column"] == "x"] == [("x", 2)]


def test_file_order_across_two_csv_files(spark, tmp_path):
    d = tmp_path / "csvs"
    d.mkdir()
    # the larger second file would be numbered first by partition id alone
    (d / "a.csv").write_text("k,v\n1,10\n2,\n")
    (d / "b.csv").write_text("k,v\n" + "".join(f"{i},\n" for i in range(3, 400)) + "400,7\n")
    df = read_table(spark, str(d))
    filled = C.fill_forward_backward(df, ["v"])  # default order: file, split, row
    got = {r["k"]: r["v"] for r in filled.collect()}
    assert got[2] == 10 and got[3] == 10 and got[399] == 10 and got[400] == 7
    first = C.dedupe(df.select("v"))
    assert first.count() == 3


def test_csv_odd_column_names(spark, tmp_path):
    p = tmp_path / "odd.csv"
    p.write_text("a`b,c.d, e \n1,2.5,x\n,NA,y\n")
    df = read_table(spark, str(p))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string"]
    assert df.where(F.col("`a``b`").isNull()).count() == 1


def test_sensor_mean_of_means_not_cell_mean(spark):
    from prepark.operators.sensors import sensor_features
    df = spark.createDataFrame([(1.0, 10.0), (3.0, None), (5.0, None)], "a double, b double")
    r = sensor_features(df).first()
    assert r["mean_all"] == r["mean_of_means"] == (3.0 + 10.0) / 2  # not the cell mean 19/4
    assert r["std_all"] == 2.0  # sd(a) = 2, sd(b) undefined for one value and skipped
    assert (r["max_all"], r["min_all"]) == (10.0, 1.0)


def test_sliding_sensor_windows_match_brute_force(spark):
    from datetime import datetime, timedelta
    from prepark.operators.sensors import sensor_windows
    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(minutes=7 * i), "d1" if i % 3 else "d2", float(i), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, dev string, x double, y double")
    got = {(r["window_start"], r["dev"]): (r["max_all"], r["min_all"])
           for r in sensor_windows(df, "ts", "1 hour", "30 minutes", device_col="dev", columns=["x", "y"]).collect()}
    exp = {}
    for ts, dev, x, y in rows:
        start = ts.replace(minute=0 if ts.minute < 30 else 30, second=0)
        for s in (start, start - timedelta(minutes=30)):
            lo, hi = exp.get((s, dev), (float("inf"), float("-inf")))
            exp[(s, dev)] = (min(lo, x, y), max(hi, x, y))
    assert got == {k: (hi, lo) for k, (lo, hi) in exp.items()}


@pytest.mark.parametrize("big", [False, True])
def test_packed_order_matches_struct_order(spark, big):
    import random
    from prepark.functions.kinds import packed_order
    rnd = random.Random(5)
    scale = 2 ** 40 if big else 100  # 3 x 41 bits forces decimal(38,0)
    rows = [(rnd.choice([None, rnd.randrange(-scale, scale)]), rnd.choice([None, rnd.randrange(scale)]),
             rnd.randrange(-scale, scale)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    key = packed_order(df, ["a", "b", "c"])
    assert key is not None
    got = [tuple(r)[:3] for r in df.withColumn("k", key).orderBy("k").collect()]
    exp = sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    assert got == exp
