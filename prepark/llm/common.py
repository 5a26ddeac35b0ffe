"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, write_scratch

#: words are runs of anything but the six ASCII white-space characters
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text. ``bytes.split`` cuts at exactly the six ASCII
    white-space characters of ``WORD_PATTERN`` (``str.split`` would cut at more)."""
    return text.split() if text else []


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (long columns ``a``, ``b``), one
    label per component.

    Rounds of contraction: every node points to its smallest neighbour (or
    itself), edges and earlier labels follow the pointers, loops and repeats
    go. Each round at least halves the nodes that still have edges, so rounds
    grow with the logarithm of the component size. A hub's edges collapse in
    the partial aggregate; joins on a hub are split by AQE. Each round is cut
    by a table in the shared folder."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = write_scratch(both.filter("a <> b").distinct(), "cc-edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while not edges.isEmpty():
        smallest = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        smallest = write_scratch(smallest, "cc-min")
        to_a = smallest.select("a", F.col("m").alias("ma"))
        to_b = smallest.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        edges = write_scratch(edges.join(to_a, "a").join(to_b, "b").filter("ma <> mb")
                              .select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct(), "cc-edges")
        step = smallest.select(F.col("a").alias("label"), "m")
        labels = write_scratch(labels.join(step, "label", "left")
                               .select("node", F.coalesce("m", "label").alias("label")), "cc-labels")
    return labels
