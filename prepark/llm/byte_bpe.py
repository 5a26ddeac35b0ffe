"""5. Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Encoding, one lazy plan with two shuffles of packed rows:

1. Explode: every input partition cuts its rows into batches, pre-tokenises
   the whole texts and keeps each batch's pre-tokens with their positions as
   one row (codes in text order, the documents' ids and token counts), and its
   distinct pre-tokens as one row per word bucket (pre-aggregated: a word that
   a batch holds a million times travels once).
2. Word shuffle: the rows of a bucket meet, each distinct word of the corpus is
   encoded once, and the ids go back to every batch that asked.
3. Batch shuffle: a batch's positions meet the ids of its words and the texts
   are put together again by position.

A batch holds at most ``BATCH_TOKENS`` pre-tokens (or one longer text), a
bucket row at most a batch's share of distinct words; common words add one
reference per batch, not one per use. Decoding looks each id up in the
token-byte table, whose size is the vocabulary file's.

Null and empty texts have no ids and decode to no bytes. Rows are kept one to
one, repeated rows and null ids included. Columns other than the two named are
ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width
from .wordtable import IdRuns, pack, release, spread, unpack

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
BATCH_TOKENS = 3_000_000
#: rows and pre-tokens that are unpacked at a time
SLICE_ROWS = 500
SLICE_TOKENS = 250_000


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: (all bytes in id order, start by id, length by id)."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    lengths = np.fromiter(map(len, table), np.int64, len(table))
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + b"".join(words))


def _unpack_words(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64) + 4 * n
    starts = np.concatenate(([4 * n], ends[:-1]))
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def _explode(schema: pa.Schema, n_buckets: int):
    """Rows (id, text) -> rows of ``schema``: a batch's positions and its words by bucket."""

    def flush(batch: int, ids: list, counts: list[int], codes: array, words: dict[str, int]) -> pa.RecordBatch:
        codes = np.frombuffer(codes, np.uint32) if codes else np.empty(0, np.uint32)
        by_use = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # common words get small codes
        rank = np.empty(len(words), np.uint32)
        rank[by_use] = np.arange(len(words))
        spelled = list(words)
        spelled = [spelled[k].encode() for k in by_use.tolist()]
        bucket = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled)) % n_buckets
        rows = [(n_buckets + batch, batch, -1, ids, counts, pack(rank[codes]), pack(bucket), len(words))]
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in range(n_buckets):
            if cuts[k] < cuts[k + 1]:
                own = [spelled[i] for i in order[cuts[k]:cuts[k + 1]].tolist()]
                rows.append((k, batch, k, None, None, _pack_words(own), None, len(own)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        find = regex.compile(public_tokenizers.PATTERN).findall
        part, k = TaskContext.get().partitionId(), 0
        ids, counts, codes, words = [], [], array("I"), {}
        slices = (rows.slice(at, SLICE_ROWS) for rows in batches for at in range(0, rows.num_rows, SLICE_ROWS))
        for rows in slices:
            for i, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()):
                tokens = find(text) if text else []
                codes.extend([words.setdefault(t, len(words)) for t in tokens])
                ids.append(i)
                counts.append(len(tokens))
                if len(codes) >= BATCH_TOKENS:
                    yield flush((part << 24) + k, ids, counts, codes, words)
                    ids, counts, codes, words, k = [], [], array("I"), {}, k + 1
        if ids:
            yield flush((part << 24) + k, ids, counts, codes, words)
        ids, counts, codes, words = [], [], array("I"), {}
        release()

    return run


def _encode_words(schema: pa.Schema, path: str):
    """One bucket: each distinct word once; every batch's row of words becomes its
    ids, in the same order. A row of positions passes through."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket").to_pylist()
        if bucket[0] < 0:
            return rows
        encode, known, out = _encoding(path).encode_ordinary, {}, []
        for data, n in zip(rows.column("data").to_pylist(), rows.column("n_words").to_pylist()):
            got = []
            for w in _unpack_words(data, n):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = encode(w.decode())
                got.append(ids)
            lengths = np.fromiter(map(len, got), np.uint32, n)
            flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(lengths.sum()))
            out.append((pack(lengths), pack(flat)))
        return (rows.set_column(schema.get_field_index("data"), "data", pa.array([x[0] for x in out], pa.binary()))
                .set_column(schema.get_field_index("more"), "more", pa.array([x[1] for x in out], pa.binary())))

    return run


def _bytes_of(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, bytes by id) from the token-byte table."""
    table, starts, lengths = _token_bytes(path)
    return table[spread(starts[ids], lengths[ids])], lengths[ids]


def _reassemble(schema: pa.Schema, path: str, decode: bool):
    """One batch: positions + the ids of its words -> one row (id, ids, bytes) per document."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = np.array(rows.column("bucket").to_pylist())
        data, more = rows.column("data").to_pylist(), rows.column("more").to_pylist()
        at = int(np.flatnonzero(bucket < 0)[0])
        codes, bucket_of = unpack(data[at]), unpack(more[at])
        lengths = np.zeros(len(bucket_of), np.int64)
        parts, place = {}, np.argsort(bucket_of, kind="stable")  # words in the order the buckets hold them
        cuts = np.searchsorted(bucket_of[place], np.arange(int(bucket_of.max(initial=0)) + 2))
        for k in range(len(bucket)):
            if (b := int(bucket[k])) >= 0:
                parts[b] = unpack(more[k])
                lengths[place[cuts[b]:cuts[b + 1]]] = unpack(data[k])  # raises if a word has no answer or two
        if len(bucket_of) and not (lengths > 0).all():
            raise ValueError("a batch's words and their ids don't match; its rows were not read the same way twice")
        flat = np.concatenate([parts[b] for b in sorted(parts)]).astype(np.int32) if parts else np.empty(0, np.int32)
        runs = IdRuns(lengths, flat)
        runs.starts[place] = np.cumsum(lengths[place]) - lengths[place]
        names = rows.column("ids")[at].values
        ends = np.cumsum(rows.column("counts")[at].values.to_numpy(), dtype=np.int64)
        parts, doc = [], 0
        while doc < len(names):  # some documents at a time
            first = int(ends[doc - 1]) if doc else 0
            upto = max(doc + 1, int(np.searchsorted(ends, first + SLICE_TOKENS, side="right")))
            own = codes[first:int(ends[upto - 1])]
            n_ids = np.concatenate(([0], np.cumsum(lengths[own])))[np.concatenate(([first], ends[doc:upto])) - first]
            flat_ids = runs.of(own)
            cols = [names[doc:upto], pa.ListArray.from_arrays(n_ids.astype(np.int32), pa.array(flat_ids, pa.int32()))]
            if decode:
                text, n_bytes = _bytes_of(flat_ids, path)
                at = np.concatenate(([0], np.cumsum(n_bytes)))[n_ids].astype(np.int32)
                cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(text)]))
            parts.append(pa.Table.from_arrays(cols, schema=schema))
            doc = upto
        del codes, runs, flat, rows
        release()
        return pa.concat_tables(parts)

    return run


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
               decode: bool = False) -> DataFrame:
    """One row (``id_col``, ids array<int>) per input row; with ``decode``, also ``decoded``: the bytes
    that the ids decode to, looked up while a batch is in hand."""
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path or public_tokenizers.path(RANK_FILE)
    spark = docs.sparkSession
    n_buckets = shuffle_width(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType
    packed = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.LongType()),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("data", T.BinaryType()), T.StructField("more", T.BinaryType()), T.StructField("n_words", T.LongType())])
    result = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decode:
        result = result.add("decoded", T.BinaryType())
    arrow = to_arrow_schema(packed)
    batches = source.mapInArrow(_explode(arrow, n_buckets), packed)
    answered = batches.groupBy("key").applyInArrow(_encode_words(arrow, path), packed)
    return answered.groupBy("batch").applyInArrow(_reassemble(to_arrow_schema(result), path, decode), result)


def bpe_decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``tokens`` with the bytes of ``ids_col`` in ``out_col`` (null ids: null)."""
    path = path or public_tokenizers.path(RANK_FILE)

    @F.pandas_udf(T.BinaryType())
    def decode(ids: pd.Series) -> pd.Series:
        out = []
        for x in ids:
            x = None if x is None else np.asarray(x, np.int64)
            out.append(None if x is None else _bytes_of(x, path)[0].tobytes() if len(x) else b"")
        return pd.Series(out, dtype=object)

    return tokens.withColumn(out_col, decode(F.col(ids_col)))
