"""J1 with memory over several batches: dedupe, fill and bounds go on where the last batch stopped."""

import statistics

import pytest
from pyspark.sql import functions as F

from prepark.streaming import streams as J

SCHEMA = "id long, kind string, x double"
PARTS = [
    [(1, None, 1.0), (2, "a", None), (3, None, 3.0), (4, "a", 1.0)],
    [(5, None, None), (6, "a", 1.0), (7, "b", 2.0), (8, None, 3.0)],  # 6 repeats 4, 8 repeats 3
    [],
    [(9, None, 50.0), (10, None, 2.5), (11, "b", 2.0)],  # 11 repeats 7
]


def feed(spark, folder, parts, at=0):
    for k, rows in enumerate(parts, at):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={k}")


def drain(spark, base, k=None, **kw):
    stream = J.file_stream(spark, f"{base}/src/part=*", spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    J.clean_stream_stateful(stream, f"{base}/sink", f"{base}/state", f"{base}/ckpt", order_by="id", k=k, **kw).awaitTermination()


def result(spark, base):
    return sorted(tuple(r) for r in spark.read.parquet(f"{base}/sink").select("id", "kind", "x").collect())


FILLED = [(1, "a", 1.0), (2, "a", 1.0), (3, "a", 3.0), (4, "a", 1.0), (5, "a", 1.0), (7, "b", 2.0), (9, "b", 50.0), (10, "b", 2.5)]


def test_batches_fill_and_dedupe_as_one_table(spark, tmp_path):
    base = str(tmp_path)
    feed(spark, f"{base}/src", PARTS)
    drain(spark, base)
    assert result(spark, base) == FILLED


def test_restart_goes_on_with_the_state(spark, tmp_path):
    base = str(tmp_path)
    feed(spark, f"{base}/src", PARTS[:1])
    drain(spark, base)
    feed(spark, f"{base}/src", PARTS[1:], at=1)
    drain(spark, base)
    assert result(spark, base) == FILLED


def test_replayed_epoch_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    clean = J.StatefulCleaner(f"{base}/sink", f"{base}/state", "id", k=None)
    frames = [spark.createDataFrame(p, SCHEMA) for p in PARTS]
    for epoch, frame in enumerate(frames):
        clean(frame, epoch)
        clean(frame, epoch)
    assert result(spark, base) == FILLED


def test_bounds_are_those_of_all_rows_so_far(spark, tmp_path):
    base = str(tmp_path)
    clean = J.StatefulCleaner(f"{base}/sink", f"{base}/state", "id", k=1.0)
    seen = []
    for epoch, rows in enumerate([[(i, "a", float(i % 5)) for i in range(20)], [(i, "b", float(i % 7)) for i in range(20, 60)]]):
        clean(spark.createDataFrame(rows, SCHEMA), epoch)
        first = {}
        for i, kind, x in rows:
            first.setdefault((kind, x), (i, kind, x))
        seen += [r[2] for r in first.values()]
        mean, sd = statistics.mean(seen), statistics.stdev(seen)
        got = spark.read.parquet(f"{base}/sink/_epoch={epoch}").select("id", "kind", "x").collect()
        assert sorted(tuple(r) for r in got) == sorted(r for r in first.values() if mean - sd < r[2] < mean + sd)
        kept = spark.read.parquet(f"{base}/state/moments").where(F.col("_epoch") == epoch).first()
        assert kept.n == len(seen) and kept.mean == pytest.approx(mean)


def test_remember_forgets_older_epochs(spark, tmp_path):
    base = str(tmp_path)
    clean = J.StatefulCleaner(f"{base}/sink", f"{base}/state", "id", k=None, remember=1)
    for epoch, at in enumerate((1, 2, 3)):
        clean(spark.createDataFrame([(at, "a" if epoch != 1 else "b", 1.0)], SCHEMA), epoch)
    assert result(spark, base) == [(1, "a", 1.0), (2, "b", 1.0), (3, "a", 1.0)]


def test_null_cells_do_not_make_rows_equal(spark, tmp_path):
    base = str(tmp_path)
    clean = J.StatefulCleaner(f"{base}/sink", f"{base}/state", "id", k=None)
    schema = "id long, p string, q string"
    clean(spark.createDataFrame([(1, None, "a")], schema), 0)
    clean(spark.createDataFrame([(2, "a", None)], schema), 1)
    assert spark.read.parquet(f"{base}/sink").count() == 2
