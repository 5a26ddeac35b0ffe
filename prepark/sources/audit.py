"""A6 append-only JSON-lines audit log, A7 tail, A8 current state per actor.

A long log is kept as batches (one folder per batch id, so a replayed append changes
nothing) and a state snapshot: ``compact_audit`` folds the batches a snapshot does not
hold yet into a new one, and ``audit_state_compacted`` reads the snapshot and the newer
batches only.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import qcol
from ..functions.paths import children, exists, mark

AUDIT_SCHEMA = "ts string, action string, details map<string,string>"


def audit_rows(df: DataFrame, action: str | None = None, action_col: str | None = None,
               detail_cols: list[str] | None = None, ts_col: str | None = None) -> DataFrame:
    """Shape any frame into audit entries ``{ts, action, details}``."""
    ts = (F.date_format(qcol(ts_col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if ts_col
          else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    act = qcol(action_col) if action_col else F.lit(action)
    cols = detail_cols or []
    details = (F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[qcol(c).cast("string") for c in cols]))
               if cols else F.create_map().cast("map<string,string>"))
    return df.select(ts.alias("ts"), act.alias("action"), details.alias("details"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines. Errors propagate (the reference swallows them)."""
    entries.select("ts", "action", "details").write.mode("append").json(path)


def log_action(spark: SparkSession, path: str, action: str, details: dict | None = None) -> None:
    """A6 for one event, with a UTC ISO time stamp as in the reference."""
    ts = datetime.now(timezone.utc).replace(tzinfo=None).isoformat() + "Z"
    row = [(ts, action, {str(k): str(v) for k, v in (details or {}).items()})]
    append_audit(spark.createDataFrame(row, AUDIT_SCHEMA), path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def audit_tail(log: DataFrame, n: int = 10, ts_col: str = "ts", tie_col: str | None = None) -> DataFrame:
    """The latest ``n`` entries, newest first (by time, then the tie column).

    Planned as TakeOrderedAndProject: every partition keeps only its top n.
    """
    order = [qcol(ts_col).desc()] + ([qcol(tie_col).desc()] if tie_col else [])
    return log.orderBy(*order).limit(n)


def audit_state(log: DataFrame, actor_col: str, action_col: str = "action", ts_col: str = "ts",
                tie_col: str | None = None) -> DataFrame:
    """The latest action per actor (e.g. granted / revoked), with its time.

    ``max_by`` is a partial aggregate: an actor with a third of all entries
    is reduced map-side before the shuffle.
    """
    key = F.struct(qcol(ts_col), qcol(tie_col)) if tie_col else qcol(ts_col)
    latest = F.max_by(F.struct(qcol(action_col).alias("state"), qcol(ts_col).alias("since"),
                               *([qcol(tie_col).alias(tie_col)] if tie_col else [])), key)
    return log.groupBy(qcol(actor_col)).agg(latest.alias("_l")).select(actor_col, "_l.*")


# ------------------------------------------------- batches and snapshots
def append_batch(entries: DataFrame, path: str, batch_id: int) -> bool:
    """A6, once per batch: entries go to the folder of ``batch_id``. A batch that was
    written whole is left as it is (False), so an append may be replayed; one that broke
    off has no ``_SUCCESS`` file, is not read, and is written anew."""
    folder = f"{path.rstrip('/')}/batches/batch={int(batch_id)}"
    if exists(entries.sparkSession, f"{folder}/_SUCCESS"):
        return False
    entries.select("ts", "action", "details").write.mode("overwrite").json(folder)
    return True


def _whole(spark: SparkSession, path: str, folder: str) -> list[int]:
    """Ids of the batches or snapshots (the ``folder``) that were written whole, ascending."""
    root = f"{path.rstrip('/')}/{folder}"
    return sorted(int(c.split("=")[1]) for c in children(spark, root) if "=" in c and exists(spark, f"{root}/{c}/_SUCCESS"))


def _latest(entries: DataFrame) -> DataFrame:
    """(actor, state, since): the last entry of each actor; of equal times, the largest action.
    The states of parts fold by the same rule to the state of the whole."""
    return (entries.groupBy("actor").agg(F.max(F.struct("since", "state")).alias("_l"))
            .select("actor", "_l.state", "_l.since"))


def _batch_entries(spark: SparkSession, path: str, ids: list[int], actor_key: str) -> DataFrame:
    folders = [f"{path.rstrip('/')}/batches/batch={i}" for i in ids]
    log = spark.read.schema(AUDIT_SCHEMA).json(folders) if folders else spark.createDataFrame([], AUDIT_SCHEMA)
    return log.select(F.col("details")[actor_key].alias("actor"), F.col("action").alias("state"), F.col("ts").alias("since"))


def _newest(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[int]]:
    """The newest whole snapshot's states, and the batches that it does not hold."""
    batches, snapshots = _whole(spark, path, "batches"), _whole(spark, path, "snapshots")
    if not snapshots:
        return None, batches
    folder = f"{path.rstrip('/')}/snapshots/snapshot={snapshots[-1]}"
    held = {r["batch"] for r in spark.read.schema("batch bigint").parquet(f"{folder}/held").collect()}  # ids, no entries
    return spark.read.parquet(f"{folder}/states"), [b for b in batches if b not in held]


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of a log kept in batches."""
    folders = [f"{path.rstrip('/')}/batches/batch={i}" for i in _whole(spark, path, "batches")]
    return spark.read.schema(AUDIT_SCHEMA).json(folders) if folders else spark.createDataFrame([], AUDIT_SCHEMA)


def audit_state_compacted(spark: SparkSession, path: str, actor_key: str) -> DataFrame:
    """A8 of a log in batches: ``(actor, state, since)`` from the newest snapshot and the
    batches it does not hold, late ones included. Entries whose details lack ``actor_key``
    are the null actor's. An empty log has no rows."""
    states, newer = _newest(spark, path)
    entries = _batch_entries(spark, path, newer, actor_key)
    return _latest(entries if states is None else states.unionByName(entries))


def compact_audit(spark: SparkSession, path: str, actor_key: str) -> bool:
    """Write a new snapshot that holds every whole batch; False where none is newer. The
    snapshot counts once its ``_SUCCESS`` file stands, which is written last, so a compaction
    that breaks off changes nothing. A log has one ``actor_key`` and one compaction at a time;
    its batches stay (they are the log)."""
    _, newer = _newest(spark, path)
    if not newer:
        return False
    batches, snapshots = _whole(spark, path, "batches"), _whole(spark, path, "snapshots")
    folder = f"{path.rstrip('/')}/snapshots/snapshot={snapshots[-1] + 1 if snapshots else 0}"
    audit_state_compacted(spark, path, actor_key).write.mode("overwrite").parquet(f"{folder}/states")
    held = spark.createDataFrame([(b,) for b in batches], "batch bigint")
    held.coalesce(1).write.mode("overwrite").parquet(f"{folder}/held")
    mark(spark, f"{folder}/_SUCCESS")
    return True
