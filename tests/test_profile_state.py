"""Profile states: merged parts equal the whole."""

import math

import pytest
from pyspark.sql import functions as F

from prepark.operators import profile_state as PS
from prepark.plans.catalog import table
from paths import SF01


def rows(state):
    return {r["column"]: r.asDict() for r in PS.state_summary(state).collect()}


def test_merged_parts_equal_the_whole(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 9 = 0, double('NaN'), 1e9 + id % 7) as x",
                                      "if(id % 5 = 0, null, concat('t', id % 40)) as `a.b`", "cast(null as int) as none")
    whole = rows(PS.profile_state(df))
    parts = [df.where(F.col("id") % 4 == 0), df.where(F.col("id") % 4 == 1), df.where(F.col("id") % 4 > 1), df.where("id < 0")]
    states = PS.profile_state(parts[0])
    for p in parts[1:]:
        states = states.unionByName(PS.profile_state(p))
    got = rows(PS.merge_states(states))
    assert list(got) == df.columns
    for c, w in whole.items():
        for k in ("n_rows", "n_missing", "min", "max"):
            assert got[c][k] == w[k], (c, k)
        assert got[c]["approx_distinct"] == pytest.approx(w["approx_distinct"], rel=0.05), c
        for k in ("mean", "std"):
            assert (got[c][k] is None) == (w[k] is None) and (w[k] is None or math.isclose(got[c][k], w[k], rel_tol=1e-9)), (c, k)
    exact = df.where("not isnan(x)").agg(F.stddev_samp("x")).first()[0]
    assert got["x"]["std"] == pytest.approx(exact, rel=1e-9) and got["x"]["approx_distinct"] == 7
    assert got["a.b"]["approx_distinct"] == 32 and got["none"]["approx_distinct"] == 0


def test_distinct_counts_are_within_the_sketch_error(spark):
    orders = table(spark, SF01, "orders")
    halves = [orders.where(F.col("o_orderkey") % 2 == p) for p in (0, 1)]
    got = rows(PS.merge_states(PS.profile_state(halves[0]).unionByName(PS.profile_state(halves[1]))))
    exact = orders.agg(*[F.countDistinct(c).alias(c) for c in orders.columns]).first()
    for c in orders.columns:
        assert abs(got[c]["approx_distinct"] - exact[c]) <= max(1, 0.05 * exact[c]), c


def test_empty_and_types_that_differ(spark):
    empty = PS.merge_states(PS.profile_state(spark.createDataFrame([], "x double, t string")))
    assert [(r["n_rows"], r["n_missing"], r["mean"], r["std"]) for r in PS.state_summary(empty).collect()] == [(0, 0, None, None)] * 2
    both = PS.profile_state(spark.range(3)).unionByName(PS.profile_state(spark.range(2).selectExpr("string(id) as id")))
    got = PS.state_summary(PS.merge_states(both)).collect()
    assert sorted((r["dtype"], r["n_rows"]) for r in got) == [("bigint", 3), ("string", 2)]


def test_a_replayed_part_counts_once(spark, tmp_path):
    for part in (0, 1, 0):
        PS.write_state(spark.range(10), str(tmp_path), part)
    assert rows(PS.merge_states(PS.read_states(spark, str(tmp_path))))["id"]["n_rows"] == 20


def test_one_aggregate_without_distinct_values_in_the_shuffle(spark):
    plan = PS.profile_state(table(spark, SF01, "orders"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Expand" not in plan
