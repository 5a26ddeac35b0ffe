"""C5 blocks: whole keys, hot values, equal rows, missing groups; and what the plans hold."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepark.operators import ordered
from prepark.operators.clean import fill_forward_backward
from prepark.operators.ordered import BLK, assign_blocks, ffill_bfill
from prepark.plans.catalog import QUERIES
from paths import SF01


def blocks_of(df, order, n=32, **kw):
    blocked, _ = assign_blocks(df, order, n, **kw)
    return [r["count"] for r in blocked.groupBy(BLK).count().collect()], blocked


@pytest.mark.parametrize("order", ["lead, id", "text, id", "lead"])
def test_a_hot_leading_value_spreads(spark, order):
    df = spark.range(200_000).selectExpr("1 as lead", "concat('same beginning of a rather long text key ', id % 2) as text", "id * 7919 % 200003 as id")
    key = F.struct(*[F.col(c.strip()) for c in order.split(",")]) if "," in order else F.col(order)
    sizes, blocked = blocks_of(df, key)
    assert len(sizes) > 16 and max(sizes) < 3 * 200_000 / 32
    # ranges in order: no block reaches into the next
    ends = blocked.groupBy(BLK).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(BLK).collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(ends, ends[1:]))


def test_equal_rows_are_dealt_out(spark):
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', lpad(cast(id as string), 6, '0')) as k", "cast(null as int) as v")
    sizes, _ = blocks_of(df, F.col("k"), spread=True)
    assert max(sizes) < 60_000 / 8


@pytest.mark.parametrize("order", [["day", "n"], "code", "day"])
def test_fill_equals_pandas(spark, order):
    rows = [(k // 40, f"c{k:05d}", k, None if k % 3 else float(k), "x" if k % 50 == 7 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "day int, code string, n int, v double, w string").repartition(5)
    if order == "day":  # ties in any order: every row has a value of its day or of the days before
        got = fill_forward_backward(df, ["v"], order_by="day", n_blocks=7).collect()
        assert len(got) == 400 and all(r["v"] is not None and int(r["v"]) // 40 in (r["day"], r["day"] - 1) for r in got)
        return
    want = pd.DataFrame(rows, columns=["day", "code", "n", "v", "w"])
    want[["v", "w"]] = want[["v", "w"]].ffill().bfill()
    got = fill_forward_backward(df, ["v", "w"], order_by=order, n_blocks=7).toPandas().sort_values("n")
    assert got["v"].tolist() == want["v"].tolist() and got["w"].tolist() == want["w"].tolist()


def test_missing_group_is_a_group(spark):
    rows = [(None if k % 2 else "g", k, None if k not in (10, 21) else k) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    got = ffill_bfill(df, ["v"], F.col("n"), partition_by=["g"], n_blocks=6)
    assert {(r["g"], r["v"]) for r in got.collect()} == {("g", 10), (None, 21)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, n int, v double")
    assert fill_forward_backward(df, ["v"], order_by=["a", "n"]).count() == 0
    assert fill_forward_backward(df, ["v"], order_by="a").count() == 0


@pytest.mark.parametrize("key", ["fill_global", "fill_grouped", "fill_struct_order", "fill_text_order"])
def test_no_sorted_aggregate_over_cells(spark, key):
    plan = QUERIES[key](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("n", [2, 7, 64, 100])
def test_blocks_by_edges_are_searched_without_carrying_the_edges(spark, monkeypatch, n):
    """A row that carries all edges costs as much as there are blocks; the place is the count of edges up to the key."""
    written, write = [], ordered.write_scratch
    monkeypatch.setattr(ordered, "write_scratch", lambda df, name: written.append(write(df, name)) or written[-1])
    df = spark.range(5000).selectExpr("if(id % 9 = 0, null, concat('k', id % 3)) as day", "id * 7919 % 5003 as id")
    key = F.struct("day", "id")
    blocked, _ = assign_blocks(df, key, n)
    assert "BroadcastNestedLoopJoin" not in blocked._jdf.queryExecution().executedPlan().toString()
    edges = written[-1].selectExpr("inline(edges)")
    want = blocked.join(F.broadcast(edges.withColumnRenamed("k", "e")), F.struct("e", "h") <= ordered._whole_key(df, key), "left").groupBy("id", BLK).agg(F.count("e").alias("n"))
    assert want.count() == 5000 and want.filter(F.col(BLK) != F.col("n")).isEmpty()
    assert want.select(BLK).distinct().count() == n
