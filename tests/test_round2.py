"""Faults found on real-looking tables: repeated rows, missing cells, free text, odd labels, replays."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from prepark.operators import clean as C
from prepark.operators import iforest as IF
from prepark.operators import models as ML
from prepark.operators import profile as P
from prepark.operators.sensors import sensor_features
from prepark.sources.files import read_table, safe_output_name, write_table


def test_isolation_forest_on_repeated_rows(spark):
    """60,000 rows of 200 tuples: trees are deep, a far row is flagged, partitions don't matter."""
    rng = np.random.default_rng(1)
    tuples = rng.integers(0, 400, (200, 2)).astype(float)
    pdf = pd.DataFrame(tuples[rng.integers(0, 200, 60_000)], columns=["a", "b"])
    pdf.loc[0] = [1e6, 1e6]
    df = spark.createDataFrame(pdf)
    models = [IF.fit_isolation_forest(df.repartition(n), contamination=0.01) for n in (1, 4, 17)]
    assert np.median(models[0].nodes.groupby("tree").size()) > 50
    assert models[0].nodes.equals(models[1].nodes) and models[0].nodes.equals(models[2].nodes)
    assert models[0].score(df.where("a = 1e6")).first()["is_fraud"]
    assert models[0].nodes.query("node == 0")["size"].eq(256).all()


def test_isolation_forest_sampled_by_key(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 * 1.0 as x", "id % 11 * 1.0 as y")
    a, b = (IF.fit_isolation_forest(df.repartition(n), key="id") for n in (2, 9))
    assert a.features == ["x", "y"] and a.nodes.equals(b.nodes)


def test_scoring_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(9007199254740993, 1.0), (None, 2.0), (3, None)], "big long, x double")
    model = IF.fit_isolation_forest(spark.range(100).selectExpr("id * 1.0 as x"))
    out = model.score(df)
    assert {r["big"] for r in out.collect()} == {9007199254740993, None, 3}
    assert [r["score"] is None for r in out.orderBy("x").collect()] == [True, False, False]
    assert dict(out.dtypes)["big"] == "bigint"


@pytest.mark.parametrize("values", [("yes", "no"), (True, False), (1, 2), (2.5, 7.5)])
def test_logistic_labels_of_any_kind(spark, values):
    rows = [(float(i), values[i >= 50]) for i in range(100)]
    df = spark.createDataFrame(rows, ["x", "target"])
    model, metrics = ML.train_logistic(df)
    assert metrics["roc_auc"] == 1.0
    gap = spark.createDataFrame([(1.0,), (99.0,), (None,), (float("nan"),)], "x double")
    got = {str(r["x"]): (r["predicted_label"], r["risk"] is None) for r in ML.predict(model, gap).collect()}
    assert got == {"1.0": (str(values[0]), False), "99.0": (str(values[1]), False), "None": (None, True), "nan": (None, True)}


def test_absent_and_damaged_models(spark, tmp_path):
    assert ML.load_model(str(tmp_path / "none")) is None
    assert IF.IsolationForestModel.load(spark, str(tmp_path / "none")) is None
    bad = tmp_path / "bad" / "nodes"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017, PT011 - any fault but "no model"
        IF.IsolationForestModel.load(spark, str(tmp_path / "bad"))


def test_csv_of_free_text(spark, tmp_path):
    rows = [(1, 'a "quoted" word', "1d"), (2, "two\nlines, comma", "2f"), (3, "  spaces  ", "3d"), (4, "back\\slash", None)]
    df = spark.createDataFrame(rows, "id long, text string, code string")
    write_table(df, str(tmp_path / "t"), fmt="csv")
    back = read_table(spark, str(tmp_path / "t"), fmt="csv", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == rows
    assert back.dtypes == [("id", "bigint"), ("text", "string"), ("code", "string")]


def test_csv_numbers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,c,d\n 1 ,1e3,inf,0x1\n-2,.5,1,2\n")
    got = read_table(spark, str(tmp_path / "n.csv"))
    assert got.dtypes == [("a", "bigint"), ("b", "double"), ("c", "double"), ("d", "string")]
    assert [tuple(r) for r in got.collect()] == [(1, 1000.0, float("inf"), "0x1"), (-2, 0.5, 1.0, "2")]


def test_output_names():
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert safe_output_name("a/b?c.parquet", now) == "a_b_c_20240102_030405.parquet"
    assert safe_output_name("no ext", now) == "no ext_20240102_030405.csv"


def test_dedupe_compares_whole_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 5), (3, "a", 5)], "ts int, v string, n int")
    assert C.dedupe(df, order_by="ts").count() == 3
    assert C.dedupe(df, order_by="ts", order_is_position=True).count() == 1
    assert C.dedupe(df, order_by=["ts", "n"]).count() == 3


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("nan"),)], "x double")
    assert C.three_sigma(df).count() == 20
    assert C.standard_scale(df).where("x is not null").count() == 20
    row = P.describe(df).first()
    assert (row["count"], row["mean"], row["max"]) == (20, 9.5, 19.0)
    assert P.top_variance(df).first()["variance"] == 35.0
    assert sensor_features(df).first()["max_all"] == 19.0


def test_a_replayed_epoch_adds_no_rows(spark, tmp_path):
    from prepark.streaming import streams as J
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "id long, v double")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(src)
    for run in ("a", "b"):  # the second run starts from no checkpoint, as after its loss
        s = J.file_stream(spark, src, df.schema, max_files_per_trigger=1)
        J.clean_stream(s, sink, str(tmp_path / run), order_by="id").awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 100 and out.select("_epoch").distinct().count() == 2


def test_scratch_folder_must_be_shared_off_local_mode(monkeypatch):
    from prepark import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())


def test_text_order_keys(spark):
    """ISO dates as text order a fill, whatever the number of blocks."""
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    rows = [(day, float(i) if i % 5 == 3 else None) for i, day in enumerate(days)]
    df = spark.createDataFrame(rows, "ts string, v double").repartition(5)
    want = pd.DataFrame(rows, columns=["ts", "v"]).sort_values("ts")["v"].ffill().bfill().tolist()
    for blocks in (1, 3, 40):
        out = C.fill_forward_backward(df, ["v"], order_by="ts", n_blocks=blocks).orderBy("ts").collect()
        assert [r["v"] for r in out] == want
    from prepark.operators.ordered import assign_blocks
    from pyspark.sql import functions as F
    blocked, names = assign_blocks(df, F.col("ts"), 12)
    assert blocked.groupBy(*names).count().count() > 6


def test_zero_has_one_sign_in_distinct_counts(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert P.column_summary(df).first()["n_unique"] == 2
    assert P.field_roles(df).first()["nunique"] == 2


def test_inspector_ties_go_to_the_smallest_text(spark):
    from prepark.plans.inspect import inspect
    df = spark.createDataFrame([(1, "z" * 100), (2, "A"), (3, "m"), (4, "B" * 90)], "id long, t string")
    top = inspect(df, order_by="id", pii=False)["describe_text"].where("column = 't'").first()["top"]
    assert top == "A" == P.describe_text(df, ["t"]).first()["top"]


def test_recommend_for_several_users(spark):
    from prepark.operators import recommend as G
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(6) for i in range(8) if (u + i) % 3]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    many = G.recommend(ratings, top_k=3, users=[1, 4])
    for u in (1, 4):
        one = G.recommend(ratings, u, top_k=3).collect()
        got = many.where(f"for_user = {u}").orderBy("score", ascending=False).collect()
        assert [(r["item"], round(r["score"], 9)) for r in got] == [(r["item"], round(r["score"], 9)) for r in one]
