"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove checkpoint files once nothing refers to them (the shared folder would grow otherwise)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "prepark") -> SparkSession:
    """Session for tests and the benchmark. On a cluster, build your own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system; it is read, never
    replaced. Only when it is unset (local tests) a private folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="prepark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: scratch paths given out to each application, until ``cleanup``
_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/prepark-scratch/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete the scratch tables this application has written so far; returns how many
    there were. Results are lazy and may read them: call it when they have been used."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        n += where.getFileSystem(conf).delete(where, True)
    return n


def materialize(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the shared folder (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def write_scratch(df, name: str):
    """Cut lineage with a written parquet table in the shared folder. Unlike a
    checkpoint (an RDD file), later reads prune columns and push filters down."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
