"""4. Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A window is ``width`` consecutive words of one document. A word is removed when
some window over it also starts in a document with a smaller id; windows are
judged on the input. Overlapping windows merge into maximal removal intervals.

Every window of every text is hashed and every hash is counted:

1. Each task hashes its texts in batches. Inside a batch, a hash met in several
   documents is decided at once: the smallest id keeps it, the others get the
   spans of window starts to remove. Only (hash, smallest document) goes on, as
   sorted, packed rows by hash range, so a passage that a third of all documents
   share adds one entry per batch to its range, not one per document.
2. A range's rows meet: the smallest id of a hash keeps it, every other
   document that sent it gets the hash back.
3. Decisions meet the texts by a hash of the id (one home per shuffle partition) and
   intervals are cut.

Hashes are 64 bits of a polynomial over 64-bit word hashes. Rows are kept one
to one. Null and blank texts have no words; texts shorter than a window lose
nothing; a null id counts as larger than any other, equal ids are not smaller
than each other (repeated rows keep the same words). Columns other than the two
named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, words_of
from .wordtable import spread

BATCH_WINDOWS = 4_000_000
BATCH_DOCS = 60_000
SLICE_ROWS = 500
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers stay distinct modulo 2^64


def _finish(h: np.ndarray) -> np.ndarray:
    """Even bits out of the polynomial (its low bits depend on low bits only)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(part: np.ndarray, width: int) -> np.ndarray:
    """The Rabin-Karp hash of each window of token hashes: sum of hash * BASE^distance
    to the window's end, modulo 2^64, built by joining hashes of half the length."""
    n = len(part) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, at, size, power = None, 0, 1, BASE
    while True:
        if width & size:  # append this length to the windows so far
            done = part[at:at + n] if done is None else done * power + part[at:at + n]
            at += size
        if size * 2 > width:
            return _finish(done)
        part = part[:-size] * power + part[size:]
        with np.errstate(over="ignore"):
            size, power = size * 2, power * power


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    return rolling(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), width)


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Ascending hashes: the first in full, then steps of as many bytes as the largest needs."""
    steps = np.diff(hashes)
    wide = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([wide]) + hashes[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    wide, out = data[0], np.zeros((n, 8), np.uint8)
    out[1:, :wide] = np.frombuffer(data, np.uint8, (n - 1) * wide, 9).reshape(n - 1, wide)
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending integers as (first, length) of runs without gaps."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    at = np.concatenate(([0], cut))
    return starts[at], np.diff(np.concatenate((at, [len(starts)])))


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal hash ranges begins in ascending hashes."""
    edges = np.array([(k << 64) // n for k in range(n)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _hash_windows(schema: pa.Schema, width: int, n_ranges: int):
    def flush(docs: list) -> pa.RecordBatch:
        docs.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
        ids = [d[0] for d in docs]
        rank = np.cumsum([k > 0 and ids[k] != ids[k - 1] for k in range(len(ids))])
        sizes = np.fromiter((len(d[2]) for d in docs), np.int64, len(docs))
        hashes = np.concatenate([d[2] for d in docs])
        order = np.argsort(hashes, kind="stable")  # a run starts with its smallest id
        hashes, doc = hashes[order], np.repeat(np.arange(len(docs)), sizes)[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        lowest = rank[doc[np.flatnonzero(new)]][np.cumsum(new) - 1]
        late = rank[doc] > lowest
        rows = []
        at = order[late]  # decided here: window starts to remove, by document
        at.sort()
        first = np.cumsum(sizes) - sizes
        owner = np.searchsorted(first, at, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
        by_home: dict = {}
        for k in np.unique(owner).tolist():
            s, n = _runs(at[cuts[k]:cuts[k + 1]] - first[k])
            by_home.setdefault(docs[k][3], []).append(
                (ids[k], docs[k][1], len(s), s.astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes()))
        for home, found in by_home.items():
            own, marks, n, data = zip(*found)
            rows.append((home % n_ranges, 0, home, own, marks, n, None, b"".join(data)))
        # one entry per hash and document of the smallest id (of repeated rows, the last of a run)
        keep = ~late & np.append((hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]), True)
        hashes, doc = hashes[keep], doc[keep]
        cuts = _ranges(hashes, n_ranges)
        for r in range(n_ranges):
            if (n := int(cuts[r + 1] - cuts[r])):
                used, local = np.unique(doc[cuts[r]:cuts[r + 1]], return_inverse=True)
                rows.append((r, n, None, [ids[k] for k in used.tolist()], None, None, [docs[k][3] for k in used.tolist()],
                             local.astype(np.uint16).tobytes() + _pack_sorted(hashes[cuts[r]:cuts[r + 1]])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        docs, held = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for i, text, mark, home in zip(batch.column("id").to_pylist(), texts, batch.column("mark").to_pylist(),
                                           batch.column("home").to_pylist()):
                got = window_hashes(words_of(text), width)
                if len(got):
                    docs.append((i, mark, got, home))
                    held += len(got)
                if held >= BATCH_WINDOWS or len(docs) >= BATCH_DOCS:
                    yield flush(docs)
                    docs, held = [], 0
        if docs:
            yield flush(docs)

    return run


def _count_range(schema: pa.Schema):
    """One hash range: the smallest id of each hash keeps it, other ids get the hash back
    (one packed row per home). Decisions made in batches pass through."""

    def run(rows: pa.Table) -> pa.Table:
        counts = np.array(rows.column("n").to_pylist())
        local = rows.filter(pa.array(counts == 0)).select(schema.names).cast(schema)
        rows = rows.filter(pa.array(counts > 0))
        if not len(rows):
            return local
        ids, homes, hashes, doc = [], [], [], []
        for own, home, n, data in zip(rows.column("ids").to_pylist(), rows.column("homes").to_pylist(),
                                      counts[counts > 0].tolist(), rows.column("data").to_pylist()):
            doc.append(np.frombuffer(data, np.uint16, n).astype(np.int64) + len(ids))
            hashes.append(_unpack_sorted(data[2 * n:], n))
            ids += own
            homes += home
        hashes, doc = np.concatenate(hashes), np.concatenate(doc)
        distinct = sorted({i for i in ids if i is not None})
        place = {i: k for k, i in enumerate(distinct)}
        rank = np.fromiter((place.get(i, len(distinct)) for i in ids), np.int64, len(ids))
        home_of = np.zeros(len(distinct) + 1, np.int64)
        home_of[rank] = homes
        rank = rank[doc]
        order = np.argsort(hashes)
        hashes, rank = hashes[order], rank[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        lowest = np.minimum.reduceat(rank, first)
        late = rank > np.repeat(lowest, np.diff(np.append(first, len(hashes))))
        hashes, rank = hashes[late], rank[late]
        order = np.lexsort((rank, home_of[rank]))
        hashes, rank = hashes[order], rank[order]
        new = np.flatnonzero(np.diff(rank, prepend=-1))  # one entry per id
        n_by_id, to = np.diff(np.append(new, len(rank))), rank[new]
        out = []
        for at in np.split(np.arange(len(to)), np.flatnonzero(np.diff(home_of[to])) + 1) if len(to) else []:
            own, upto = to[at].tolist(), new[at[-1]] + n_by_id[at[-1]]
            out.append((int(home_of[own[0]]), [distinct[k] if k < len(distinct) else None for k in own], None,
                        n_by_id[at].tolist(), hashes[new[at[0]]:upto].tobytes()))
        cols = list(zip(*out)) if out else [()] * len(schema)
        return pa.concat_tables([local, pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)])

    return run


def removed_words(words: list[bytes], width: int, mark: int, decisions: list) -> np.ndarray:
    """Mask of the words under a window start that some decision names: (None, hashes), or
    (mark of the text, runs of window starts)."""
    bad = np.zeros(max(0, len(words) - width + 1), bool)
    sent = [data for of, data in decisions if of is None]
    if sent:
        bad |= np.isin(window_hashes(words, width), np.frombuffer(b"".join(sent), np.uint64))
    for of, data in decisions:
        if of is not None and of == mark:
            s, n = np.frombuffer(data, np.uint32).reshape(2, -1).astype(np.int64)
            bad[spread(s, n)] = True
    edge = np.zeros(len(words) + 1, np.int64)
    if len(bad):
        at = np.flatnonzero(bad)
        edge[at] += 1
        edge[at + width] -= 1  # each start is there once, so are the ends
    return np.cumsum(edge[:-1]) > 0


def _cut(schema: pa.Schema, width: int):
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        decisions: dict = {}
        for ids, marks, counts, data in zip(*(found.column(c).to_pylist() for c in ("ids", "marks", "counts", "data"))):
            at = 0
            for i, mark, n in zip(ids, marks or [None] * len(ids), counts):
                decisions.setdefault(i, []).append((mark, data[at:at + 8 * n]))
                at += 8 * n
        parts = []
        for at in range(0, len(rows), SLICE_ROWS):
            part, out = rows.slice(at, SLICE_ROWS), []
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for i, text, mark in zip(part.column("id").to_pylist(), texts, part.column("mark").to_pylist()):
                words = words_of(text)
                if i not in decisions:
                    out.append((i, len(words), 0, [], b" ".join(words).decode()))
                    continue
                gone = removed_words(words, width, mark, decisions[i])
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).reshape(-1, 2).tolist()
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((i, len(words), int(gone.sum()), [{"start": s, "end": e} for s, e in edge], b" ".join(kept).decode()))
            parts.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_removed, spans (removed word
    intervals, end exclusive) and kept (the other words, joined by one space)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    n = shuffle_width(docs.sparkSession)
    source = docs.select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("home"), F.col(id_col).alias("id"),
                         F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    id_field = T.StructField("id", source.schema["id"].dataType)
    ids, marks = T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("marks", T.ArrayType(T.LongType()))
    counts, data = T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())
    home = T.StructField("home", T.LongType())
    packed = T.StructType([T.StructField("range", T.LongType()), T.StructField("n", T.LongType()), home, ids, marks, counts,
                           T.StructField("homes", T.ArrayType(T.LongType())), data])
    decided = T.StructType([home, ids, marks, counts, data])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    result = T.StructType([id_field, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())])
    hashed = source.mapInArrow(_hash_windows(to_arrow_schema(packed), width, n), packed)
    found = hashed.groupBy("range").applyInArrow(_count_range(to_arrow_schema(decided)), decided)
    cut = source.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(_cut(to_arrow_schema(result), width), result)
    return cut.withColumnRenamed("id", id_col)
