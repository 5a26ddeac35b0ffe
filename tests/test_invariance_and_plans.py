"""Partition invariance (same result at 1, 4 and 17 partitions) and plan shape."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paths import SF01
from prepark.operators import clean as C
from prepark.operators import iforest as IF
from prepark.operators import metrics as M
from prepark.operators import pii as E
from prepark.plans.catalog import events_gaps, events_k, table


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_fill_invariant(spark, parts):
    base = events_gaps(spark, SF01).select("event_id", "user_id", "value", "k")
    ref = _rows(C.fill_forward_backward(base.coalesce(1), ["value", "k"], order_by="event_id"))
    got = _rows(C.fill_forward_backward(base.repartition(parts), ["value", "k"], order_by="event_id",
                                        n_blocks=parts + 2))
    assert got == ref


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sigma_and_split_invariant(spark, parts):
    base = events_k(spark, SF01)
    ref = C.three_sigma(base.coalesce(1)).count()
    assert C.three_sigma(base.repartition(parts)).count() == ref == 9818
    split = base.repartition(parts).select("event_id", M.split_column(F.col("event_id")).alias("s"))
    n_test = split.where("s = 'test'").count()
    assert 1700 < n_test < 2300
    assert _rows(split) == _rows(base.coalesce(1).select("event_id", M.split_column(F.col("event_id")).alias("s")))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_pii_detect_invariant(spark, parts):
    docs = table(spark, SF01, "documents")
    ref = _rows(E.pii_detect(docs.coalesce(1), order_by="doc_id").select("column", "count_examples"))
    assert _rows(E.pii_detect(docs.repartition(parts), order_by="doc_id").select("column", "count_examples")) == ref


def test_isolation_forest_planted_outliers_and_invariance(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"amount": rng.gamma(2.0, 30.0, 2000), "age_days": rng.integers(1, 3000, 2000).astype(float),
                        "num_items": rng.integers(1, 10, 2000).astype(float), "hour": rng.integers(0, 24, 2000).astype(float)})
    pdf["id"] = np.arange(len(pdf))
    planted = np.arange(0, 2000, 200)
    normal_max = pdf.drop(index=planted)["amount"].max()
    pdf.loc[planted, "amount"] *= 10
    # a small amount times 10 is still ordinary; the planted rows beyond the normal range must be caught
    extreme = pdf.loc[planted][pdf.loc[planted, "amount"] > 1.5 * normal_max]["id"].tolist()
    df = spark.createDataFrame(pdf)
    feats = ["amount", "age_days", "num_items", "hour"]
    flagged = {}
    for parts in (1, 4, 17):
        model = IF.fit_isolation_forest(df.repartition(parts).select(*feats), contamination=0.01)
        scored = model.score(df.repartition(parts))
        flagged[parts] = sorted(r["id"] for r in scored.where("is_fraud").select("id").collect())
    assert flagged[1] == flagged[4] == flagged[17]
    assert 15 <= len(flagged[1]) <= 25
    assert len(extreme) >= 3 and set(extreme) <= set(flagged[1])


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fill_plan_has_no_unpartitioned_window(spark):
    out = C.fill_forward_backward(events_gaps(spark, SF01), ["value"], order_by="event_id")
    plan = _plan(out)
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0] or "Window" in plan
    # every window over data rows is partitioned by a block column
    for line in plan.splitlines():
        if "Window [" in line and "_blk" not in line and "_tail" not in line and "_head" not in line:
            raise AssertionError(line)


def test_top_values_use_window_group_limit(spark):
    from prepark.operators.profile import distinct_profile
    out = distinct_profile(table(spark, SF01, "orders"), order_by="o_orderkey")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "WindowGroupLimit" in _plan(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scan_prunes_columns(spark):
    out = C.three_sigma(table(spark, SF01, "lineitem").select("l_quantity"))
    plan = _plan(out)
    assert "ReadSchema: struct<l_quantity:double>" in plan


@pytest.mark.parametrize("blocks", [1, 5, 33])
def test_blocked_quantiles_equal_percentile(spark, blocks):
    from prepark.operators.ordered import exact_quantiles
    li = table(spark, SF01, "lineitem").select("l_quantity", "l_extendedprice", "l_orderkey")
    cols, probs = ["l_quantity", "l_extendedprice", "l_orderkey"], [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    direct = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(li, cols, probs).collect()}
    blocked = {(r["column"], r["prob"]): r["value"]
               for r in exact_quantiles(li, cols, probs, n_blocks=blocks, max_exact_distinct=0).collect()}
    assert direct.keys() == blocked.keys()
    for k in direct:
        assert abs(direct[k] - blocked[k]) <= 1e-9 * max(1.0, abs(direct[k])), k


def _nodes(node):
    yield node
    for i in range(node.children().size()):
        yield from _nodes(node.children().apply(i))


def _global_windows_read_aggregates(df) -> list[str]:
    """Names of the first real operator under every Window without a partition key."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []
    for n in _nodes(plan):
        if n.nodeName() == "Window" and n.partitionSpec().isEmpty():
            child = n.child()
            while child.nodeName() in ("Sort", "Exchange", "InputAdapter", "Project", "WholeStageCodegen (1)") \
                    or child.nodeName().startswith("WholeStageCodegen") or child.nodeName() == "AQEShuffleRead":
                child = child.children().apply(0)
            found.append(child.nodeName())
    return found


@pytest.mark.parametrize("key", ["fill_global", "roc_auc", "clean_records"])
def test_global_windows_only_over_block_tables(spark, key):
    from prepark.plans.catalog import QUERIES
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES[key](spark, SF01)
        under = _global_windows_read_aggregates(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(name.endswith("Aggregate") for name in under), under


def test_blocked_quantile_plan(spark):
    from prepark.operators.ordered import exact_quantiles
    li = table(spark, SF01, "lineitem").select("l_extendedprice")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        under = _global_windows_read_aggregates(exact_quantiles(li, ["l_extendedprice"], [0.5], max_exact_distinct=0))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # every window there is partitioned (by column), so there may be none at all
    assert all(name.endswith("Aggregate") for name in under), under


def test_isolation_forest_on_many_rows(spark):
    rng = np.random.default_rng(3)
    n = 30000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["id"] = np.arange(n)
    pdf.loc[:9, "a"] = 25.0  # ten far-out rows
    df = spark.createDataFrame(pdf)
    m1 = IF.fit_isolation_forest(df.repartition(3).select("a", "b"), contamination=0.01)
    m2 = IF.fit_isolation_forest(df.repartition(11).select("a", "b"), contamination=0.01)
    assert m1.nodes.equals(m2.nodes) and m1.offset == m2.offset
    flagged = m1.score(df).where("is_fraud").select("id").toPandas()["id"]
    assert 0.007 * n <= len(flagged) <= 0.013 * n
    assert set(range(10)) <= set(flagged)


def test_queries_collect_only_small_results(spark, monkeypatch):
    """Building a query may run driver actions (statistics, bounds, flags);
    none may bring back data rows -- only per-column or per-split results."""
    from pyspark.sql import DataFrame

    from prepark.plans.catalog import QUERIES

    sizes = []
    orig_collect, orig_pandas = DataFrame.collect, DataFrame.toPandas

    def collect(self):
        rows = orig_collect(self)
        sizes.append(len(rows))
        return rows

    def to_pandas(self):
        pdf = orig_pandas(self)
        sizes.append(len(pdf))
        return pdf

    monkeypatch.setattr(DataFrame, "collect", collect)
    monkeypatch.setattr(DataFrame, "toPandas", to_pandas)
    # an isolation forest's node table has at most trees x (2 psi - 1) rows
    bounds = {"isolation_forest": 51_100, "isolation_planted": 51_100}
    worst = {}
    for key, fn in QUERIES.items():
        sizes.clear()
        fn(spark, SF01)  # build only: the final action is the caller's
        worst[key] = max(sizes, default=0)
    assert all(n <= bounds.get(k, 64) for k, n in worst.items()), worst
