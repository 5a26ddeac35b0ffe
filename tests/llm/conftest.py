import os
import sys

import pytest
from pyspark.sql import types as T

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

#: names that the operators use inside and for their results
CLASHING = ["id", "fp", "label", "key", "batch", "ids", "kept", "part", "start", "line", "pos", "h", "n_words", "low"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """rows of (doc_id, text) -> a table with further columns of clashing names, some null."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           *[T.StructField(c, T.StringType()) for c in CLASHING]])

    def make(rows, partitions=3):
        full = [(i, t, *[None if k % 2 else "x" for k in range(len(CLASHING))]) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    prose = "the quick brown fox jumps over the lazy dog near the quiet river bank " * 8
    return [
        (1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "one"), (5, "two words"), (6, prose), (7, prose), (7, prose),
        (8, "a\x1cb\x85c d e f́ ́g ΣΑΣ 한 한"),
        (9, "tabs\tand\r\nlines\n\n\nhere  and   there   "), (10, "\U0001f600\U0001f1e9\U0001f1ea <|endoftext|> it's 12345"),
        (11, "x" * 30_000), (12, "aaaa " * 6_000), (13, " ".join(f"w{k}" for k in range(8_000))),
        (None, prose), (None, None), (14, "\n".join(["same line here"] * 5)), (15, "ñ ñ İ ı ß ﬃ")]
