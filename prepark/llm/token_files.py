"""6. Token ids as ORC: ascending ids, integer run-length encoding, row indexes, Bloom filters.

Texts are range-partitioned and sorted by document id, encoded where they land
and written as ORC: ids as ``array<int>`` (ORC's integer run-length encoding
packs them to their bit width), a row index entry every ``ROW_STRIDE`` rows and
a Bloom filter on the document id, so a reader of some documents skips files,
stripes and row groups by metadata, and a full reader splits by stripe. Each
row keeps its part and its offset in the part; a document's global start needs
one total per part, never an ordering of all rows.

The tokenizer drops white space and never matches across it, so a text's ids
are the ids of its white-space chunks in order; each worker encodes a distinct
word once (it keeps a table of some ``MAX_WORDS`` words, then refills it).

The strings of the tokenizer's special tokens are those tokens, as by the library's
default; they hold no white space, so they lie inside a chunk.

Null and empty texts get the end id alone. Rows are kept one to one; rows with
a null id come first, rows with equal ids are ordered by a hash of the text.
Other columns are not written.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width
from .wordtable import IdRuns, spread

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 1
MAX_WORDS = 1_000_000
CHUNK_BYTES = 8 << 20
MARKS = ".,;:!?"
ROW_STRIDE = 1000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkIds:
    """Ids of white-space chunks; each distinct word in them is encoded once by the library."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.bar = self.encode_each(["|"])[0]
        self.forget()

    def forget(self) -> None:
        self.stem, self.stem_lengths, self.stem_ids = {}, np.empty(0, np.int64), np.empty(0, np.int32)

    def encode_each(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids by chunk, all ids). The tokenizer parts ASCII letters from a mark behind them,
        so such a chunk's ids are its word's and the mark's, and the word is encoded once."""
        if len(self.stem) > MAX_WORDS:
            self.forget()
        stem, known, parts, n_parts = self.stem, len(self.stem), [], []
        for c in chunks:
            if c[-1:] in MARKS and c.isascii() and c[:-1].isalpha():
                parts += [stem.setdefault(c[:-1], len(stem)), stem.setdefault(c[-1], len(stem))]
                n_parts.append(2)
            else:
                parts.append(stem.setdefault(c, len(stem)))
                n_parts.append(1)
        lengths, ids = self.encode_stems(list(islice(stem, known, None)))
        self.stem_lengths, self.stem_ids = np.concatenate((self.stem_lengths, lengths)), np.concatenate((self.stem_ids, ids))
        runs, parts, n_parts = IdRuns(self.stem_lengths, self.stem_ids), np.array(parts, np.int64), np.array(n_parts, np.int64)
        lengths = np.add.reduceat(runs.lengths[parts], np.cumsum(n_parts) - n_parts) if len(parts) else n_parts
        return lengths, runs.of(parts)

    def encode_stems(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library: some hundred chunks at a time, between bars; those with
        a bar in them (so also strings of special tokens), one at a time."""
        barred = np.fromiter(("|" in c for c in chunks), bool, len(chunks))
        plain = [c for c, b in zip(chunks, barred.tolist()) if not b]
        lengths, parts = np.zeros(len(chunks), np.int64), [np.empty(0, np.int32)]
        joined = [" | ".join(plain[k:k + 256]) for k in range(0, len(plain), 256)]
        n_plain = []
        for k, ids in enumerate(self.encode_each(joined)):
            ids = np.array(ids, np.int32)
            bars = np.flatnonzero(ids == self.bar[0])
            n = np.diff(np.concatenate(([-1], bars, [len(ids)]))) - 1
            if len(n) != len(plain[256 * k:256 * k + 256]):
                raise ValueError("the tokenizer doesn't keep white-space chunks apart")
            n_plain.append(n)
            parts.append(np.delete(ids, bars))
        # plain chunks first, then the barred ones; put back in order by their starts
        rest = self.encode_each([c for c, b in zip(chunks, barred.tolist()) if b])
        lengths[~barred] = np.concatenate(n_plain) if n_plain else 0
        lengths[barred] = [len(ids) for ids in rest]
        parts += [np.array(ids, np.int32) for ids in rest]
        in_order = np.concatenate((lengths[~barred], lengths[barred]))
        starts = np.empty(len(chunks), np.int64)
        starts[np.concatenate((np.flatnonzero(~barred), np.flatnonzero(barred)))] = np.cumsum(in_order) - in_order
        flat = np.concatenate(parts)
        return lengths, flat[spread(starts, lengths)] if barred.any() else flat

    def of(self, texts: pa.Array | list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` appended; ids by text). Arrow cuts the texts
        and numbers the distinct chunks; only those are looked up one by one."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([None if t is None else t.decode() for t in texts], pa.string())
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        # outer white space leaves an empty chunk, which has no ids
        lengths, ids = self.encode(coded.dictionary.to_pylist())
        n_chunks = lists.value_lengths().to_numpy()
        # the end id is kept behind all others, and stands behind each text
        runs = IdRuns(np.append(lengths, 1), np.append(ids, np.int32(end)))
        whole = np.full(len(coded) + len(texts), len(lengths), np.int64)
        whole[np.arange(len(coded)) + np.repeat(np.arange(len(texts)), n_chunks)] = coded.indices.to_numpy()
        n_ids = np.add.reduceat(runs.lengths[whole], np.cumsum(n_chunks) - n_chunks + np.arange(len(texts))) if len(texts) else n_chunks
        return runs.of(whole), n_ids


@lru_cache(maxsize=1)
def _worker_table(path: str) -> ChunkIds:
    """One table per worker process: its tasks share what they have encoded."""
    return ChunkIds(path)


def _encode_part(schema: pa.Schema, path: str, end: int):
    def run(batches):
        table, part, offset = _worker_table(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
            at = 0
            while at < len(texts):  # some megabytes of text at a time
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES)))
                ids, n = table.of(texts.slice(at, upto - at), end)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[at:upto], pa.array(np.full(len(n), part, np.int32)),
                     pa.array(offset + ends - n), pa.array(n), lists], schema=schema)
                offset += int(ends[-1])
                at = upto

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``text_col`` and write ORC files in ascending ``id_col`` order under ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = ("id", F.xxhash64("text"))
    schema = T.StructType([
        T.StructField(id_col, source.schema["id"].dataType), T.StructField("part", T.IntegerType()),
        T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType()))])
    encoded = (source.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
               .mapInArrow(_encode_part(to_arrow_schema(schema), tokenizer or public_tokenizers.path(TOKENIZER_FILE), end_id),
                           schema))
    (encoded.write.mode("errorifexists").option("compression", "zstd").option("orc.create.index", "true")
     .option("orc.row.index.stride", str(ROW_STRIDE)).option("orc.bloom.filter.columns", id_col)
     .option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", ids: list | None = None) -> DataFrame:
    """The written rows; with ``ids``, those documents only, found by file, stripe and
    row-group metadata (minimum, maximum, Bloom filter)."""
    rows = spark.read.orc(path)
    return rows if ids is None else rows.filter(F.col(id_col).isin(list(ids)))


@F.pandas_udf(T.LongType())
def ids_crc32(ids):
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return ids.map(lambda x: None if x is None else zlib.crc32(np.asarray(x).astype("<u4").tobytes()))


def token_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_tokens`` with ``start``: ids of all documents before. One
    total per part is ordered (as many rows as files), the documents are not."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(firsts), "part").withColumn("start", F.col("first") + F.col("offset")).drop("first")
