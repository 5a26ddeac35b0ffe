"""Sliding panes, many-user recommendations, stream scores with gaps, missing text values."""

import pytest
from pyspark.sql import functions as F

from prepark.operators import models as ML
from prepark.operators import profile as P
from prepark.operators import recommend as G
from prepark.operators import sensors as S
from prepark.plans.catalog import QUERIES
from paths import SF01


@pytest.mark.parametrize("size,slide", [("90 minutes", "20 minutes"), ("1 hour", "1 hour"), ("7 days", "1 hour")])
def test_panes_equal_sparks_sliding_windows(spark, size, slide):
    df = spark.range(400).selectExpr("timestamp_micros(id * id * 37000000 - 5000000000) as ts", "if(id % 5 = 0, null, id % 3) as dev",
                                     "if(id % 7 = 0, null, cast(id as double)) as a", "1e9 + id % 11 as b").repartition(3)
    got = S.sensor_windows(df, "ts", size, slide, device_col="dev")
    keys = [F.window("ts", size, slide).alias("w"), "dev"]
    want = df.groupBy(*keys).agg(*S._feature_aggs(["a", "b"])).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "dev", *S._feature_cols(["a", "b"]))
    plain = lambda x: {tuple(map(str, r[:3])): r[3:] for r in x.collect()}
    g, w = plain(got), plain(want)
    assert g.keys() == w.keys() and got.count() == len(g)
    for k in w:
        assert [v is None for v in g[k]] == [v is None for v in w[k]], k
        assert [v or 0.0 for v in g[k]] == pytest.approx([v or 0.0 for v in w[k]], rel=1e-7, abs=1e-6), k


def test_panes_expand_no_row(spark):
    """The rows meet one exchange as pane sums; only panes are copied to their windows."""
    plan = QUERIES["sensor_windows_sliding"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.index("Generate") < plan.index("Scan parquet")
    below = plan[plan.index("Generate"):]
    assert "HashAggregate" in below  # the copies are made of aggregated panes


def ratings(spark):
    rows = [(u, i, float((u * 7 + i * 3) % 6)) for u in range(40) for i in range(25) if (u + i) % 4 == 0 or i == 3]
    return spark.createDataFrame([*rows, (90, 999, 2.0), (91, 998, 0.0)], "user long, item long, rating double")


@pytest.mark.parametrize("hot", [50_000, 4])
def test_many_users_equal_one_by_one(spark, monkeypatch, hot):
    monkeypatch.setattr(G, "HOT_RATINGS", hot)
    r, users = ratings(spark), [0, 5, 17, 90]
    got = G.recommend(r, top_k=6, users=users)
    for u in users:
        one = [(x["item"], round(x["score"], 9)) for x in G.recommend(r, u, 6).collect()]
        mine = [(x["item"], round(x["score"], 9)) for x in got.filter(F.col("for_user") == u).orderBy(F.desc("score"), "item").collect()]
        assert mine == one, u


def test_jobs_do_not_grow_with_the_users(spark):
    r = ratings(spark).cache()
    def jobs(n):
        tracker, group = spark.sparkContext.statusTracker(), f"users-{n}-{id(r)}"
        spark.sparkContext.setJobGroup(group, "")
        G.recommend_users(r, spark.range(n).withColumnRenamed("id", "for_user"), 3).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))
    assert abs(jobs(3) - jobs(40)) <= 3


def test_nan_is_missing_in_text_summaries(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [(r["count"], r["unique"]) for r in P.describe_text(df, ["x"]).collect()] == [(1, 1)]


def test_too_many_classes_are_an_error(spark):
    df = spark.range(400).selectExpr("id * 1.0 as x", "concat('c', id % 150) as target")
    with pytest.raises(ValueError):
        ML.train_logistic(df)


def test_cleanup_deletes_scratch_tables(spark):
    import os

    from prepark.session import cleanup, scratch_path, write_scratch
    cleanup(spark)
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    write_scratch(spark.range(3), "u")
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    assert cleanup(spark) == 2 and not os.path.exists(local) and cleanup(spark) == 0
