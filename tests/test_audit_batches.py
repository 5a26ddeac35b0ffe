"""Audit log in batches: replayed appends, snapshots, late and broken batches."""

import os

from prepark.sources import audit as AU

SCHEMA = AU.AUDIT_SCHEMA


def entries(spark, rows):
    return spark.createDataFrame([(ts, act, {"who": who} if who else {}) for ts, act, who in rows], SCHEMA)


def states(spark, path):
    return {r["actor"]: (r["state"], r["since"]) for r in AU.audit_state_compacted(spark, path, "who").collect()}


def test_a_replayed_append_adds_nothing(spark, tmp_path):
    path, batch = str(tmp_path / "log"), entries(spark, [("1", "granted", "a"), ("2", "revoked", "a")])
    assert AU.append_batch(batch, path, 7) is True
    assert AU.append_batch(batch, path, 7) is False
    assert AU.read_batches(spark, path).count() == 2


def test_snapshot_and_newer_batches_equal_the_whole_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert AU.compact_audit(spark, path, "who") is False and states(spark, path) == {}
    AU.append_batch(entries(spark, [("1", "granted", "a"), ("5", "granted", "b"), ("3", "x", None)]), path, 4)
    assert AU.compact_audit(spark, path, "who") is True and AU.compact_audit(spark, path, "who") is False
    AU.append_batch(entries(spark, [("2", "revoked", "a"), ("4", "revoked", "b"), ("5", "revoked", "b")]), path, 5)
    # a batch of a smaller id that comes after the snapshot counts too
    AU.append_batch(entries(spark, [("9", "granted", "c")]), path, 1)
    want = {"a": ("revoked", "2"), "b": ("revoked", "5"), "c": ("granted", "9"), None: ("x", "3")}
    assert states(spark, path) == want
    assert AU.compact_audit(spark, path, "who") is True and states(spark, path) == want


def test_compacted_batches_are_not_read_again(spark, tmp_path):
    path = str(tmp_path / "log")
    AU.append_batch(entries(spark, [("1", "granted", "a")]), path, 1)
    AU.compact_audit(spark, path, "who")
    AU.append_batch(entries(spark, [("2", "granted", "b")]), path, 2)
    read = " ".join(AU.audit_state_compacted(spark, path, "who").inputFiles())
    assert "batch=2" in read and "snapshot=0" in read and "batch=1" not in read


def test_batches_and_snapshots_that_broke_off_are_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    AU.append_batch(entries(spark, [("1", "granted", "a")]), path, 1)
    AU.append_batch(entries(spark, [("2", "revoked", "a")]), path, 2)
    AU.compact_audit(spark, path, "who")
    os.remove(f"{path}/batches/batch=2/_SUCCESS")
    os.remove(f"{path}/snapshots/snapshot=0/_SUCCESS")
    assert states(spark, path) == {"a": ("granted", "1")}
    assert AU.append_batch(entries(spark, [("2", "revoked", "a")]), path, 2) is True
    assert AU.compact_audit(spark, path, "who") is True and states(spark, path) == {"a": ("revoked", "2")}
