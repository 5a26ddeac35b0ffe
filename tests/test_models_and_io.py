"""Model fit/predict/save/load, audit log, record batches, quick summary."""

import pytest
from pyspark.sql import functions as F

from paths import SF01
from prepark.operators import iforest as IF
from prepark.operators import models as ML
from prepark.operators import profile as P
from prepark.operators.columns import rename_target, resolve_target
from prepark.plans.catalog import labelled_docs, table
from prepark.sources import audit as AU
from prepark.sources.records import parse_records, read_records


def test_logistic_fit_predict_save_load(spark, tmp_path):
    j = labelled_docs(spark, SF01).select("doc_id", "n_chars", "toxic", "quality")
    model, metrics = ML.train_logistic(j, target="quality", key="doc_id")
    assert 0.0 <= metrics["accuracy"] <= 1.0
    assert metrics["roc_auc"] is None or 0.0 <= metrics["roc_auc"] <= 1.0
    path = ML.save_model(model, str(tmp_path / "lr"))
    again = ML.load_model(path)
    a = ML.predict(model, j).select("doc_id", "prediction").orderBy("doc_id").collect()
    b = ML.predict(again, j).select("doc_id", "prediction").orderBy("doc_id").collect()
    assert a == b
    assert ML.load_model(str(tmp_path / "absent")) is None
    with pytest.raises(ValueError):
        ML.predict(model, j.drop("n_chars"))


def test_logistic_needs_ten_rows(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(5)], "x double, target int")
    with pytest.raises(ValueError):
        ML.train_logistic(df)


def test_isolation_forest_save_load(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    m = IF.fit_isolation_forest(df, contamination=0.05)
    m.save(spark, str(tmp_path / "if"))
    m2 = IF.IsolationForestModel.load(spark, str(tmp_path / "if"))
    s1 = [r["score"] for r in m.score(df).orderBy("a", "b").collect()]
    s2 = [r["score"] for r in m2.score(df).orderBy("a", "b").collect()]
    assert s1 == s2
    with pytest.raises(ValueError):
        IF.fit_isolation_forest(df, contamination=0.0)


def test_audit_log_roundtrip(spark, tmp_path):
    path = str(tmp_path / "audit")
    AU.log_action(spark, path, "consent_granted", {"user": "u1"})
    AU.log_action(spark, path, "upload", {"file": "x.csv"})
    log = AU.read_audit(spark, path)
    assert log.count() == 2
    assert AU.audit_tail(log, 1).first()["action"] in {"consent_granted", "upload"}


def test_record_batch_union_of_keys(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text('{"a": 1, "b": "x"}\n{"a": 2, "c": 3.5}\n')
    df = read_records(spark, str(p))
    assert sorted(df.columns) == ["a", "b", "c"]
    txt = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"b": "y"}')], "id int, payload string")
    parsed = parse_records(txt, "payload")
    assert sorted(parsed.columns) == ["a", "b", "id"]


def test_target_rename_and_resolution(spark):
    df = spark.createDataFrame([(1, 0)], "x int, Outcome int")
    assert rename_target(df).columns == ["x", "target"]
    assert resolve_target(df, "outcome") == "Outcome"
    with pytest.raises(ValueError):
        resolve_target(spark.createDataFrame([(1,)], "x int"), "target")


def test_quick_summary_text(spark):
    labels = table(spark, SF01, "labels")
    out = P.quick_summary(labels, P.field_roles(labels), order_by="doc_id")
    text = out["summary_text"]
    assert text.startswith("The dataset has 399 rows and 3 columns.")
    assert "Possible target columns: quality, toxic." in text
    assert out["preview_df"].count() == 5


def test_record_key_union_with_mixed_types(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": "two", "c": [1,2]}'), (3, '{"d": {"e": 1.5}}')],
                               "id int, p string")
    out = parse_records(df, "p")
    assert out.schema.simpleString() == "struct<id:int,a:string,b:string,c:array<bigint>,d:struct<e:double>>"
    assert [r["a"] for r in out.orderBy("id").collect()] == ["1", "two", None]
