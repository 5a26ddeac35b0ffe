"""10. Exact substring dedup by bucket-pointer refinement of q-gram buckets.

A byte is removed when some ``WINDOW``-byte string over it also starts earlier:
in a document with a smaller id, or earlier in the same document. Texts are
UTF-8 bytes, strings never cross documents and are judged on the input.

Every position starts in the bucket of its 25 bytes. Buckets are refined by
the bucket identifiers of later offsets, and each result is reused by the next
round: the 50-byte bucket of s is the pair of 25-byte buckets at s and s + 25,
the 100-byte bucket the pair of 50-byte buckets at s and s + 50. Identifiers are
64-bit mixes of the pair instead of ranks, so tasks that never meet agree on
them and a bucket needs no global numbering.

Of each 100 bytes, the leftmost smallest 50-byte identifier is the anchor; every copy of
a string has the same one. The strings that share an anchor in a place form its context
(100 to 150 bytes, 26 on average between neighbours), and refinement goes bucket by bucket:

1. Anchors and contexts are counted over the whole corpus, one entry per context and
   batch. A context that a smaller id holds too goes as a whole. An anchor bucket with
   one context left is resolved: its strings occur nowhere else.
2. Only buckets with several contexts are refined to 100-byte buckets, one by each string
   of the contexts' first holders, and sorted again: the smallest id keeps a string.
3. Removed contexts and strings meet the texts, and intervals are cut.

In a batch, only the first of equal contexts or strings goes on, as sorted packed rows by
identifier range, so a passage that a third of all documents share adds one entry per
batch. No string is sampled away.

Documents are dealt to batches by a hash (``BATCHES`` per shuffle partition, a
batch being what a task holds at a time); this one shuffle of the texts serves all passes.

Null and empty texts have no bytes. Rows are kept one to one; a null id is larger
than any other, rows of equal ids are not earlier than each other. Columns other
than the two named are ignored.
"""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width
from .windows import _finish, _pack_sorted, _ranges, _unpack_sorted
from .wordtable import release, spread

GRAM = 25
WINDOW = 4 * GRAM
ANCHOR = 2 * GRAM
BLOCK = 1 << 17
BATCHES = 1
CONTEXT_BITS = 48
GONE, REFINE = 1, 2
PLACE = np.uint64((1 << 31) - 1)  # low bits of an anchor's key: its place; the rest: its identifier


def initial_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the GRAM bytes at each position: a polynomial hash, joined from halves."""
    part = data.astype(np.uint64) + np.uint64(1)
    power, size, at, done, n = np.uint64(0xD6E8FEB86659FD93), 1, 0, None, len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        while True:
            if GRAM & size:
                done = part[at:at + n] if done is None else done * power + part[at:at + n]
                at += size
            if 2 * size > GRAM:
                return _finish(done)
            part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power


def refine(buckets: np.ndarray, offset: int) -> np.ndarray:
    """Buckets of twice the depth: pairs of the buckets at s and at s + ``offset``."""
    return _finish(buckets[:-offset] * np.uint64(0xA24BAED4963EE407) + buckets[offset:])


def anchors(b50: np.ndarray) -> np.ndarray:
    """For each WINDOW-byte string the place of its anchor: the leftmost smallest
    identifier (by its high bits) among its ANCHOR-byte strings."""
    low = (b50 & ~PLACE) | np.arange(len(b50), dtype=np.uint64)
    size, width = 1, WINDOW - ANCHOR + 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:len(low) - (width - size)], low[width - size:])
    return (low & PLACE).astype(np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _finish(a * np.uint64(0xA24BAED4963EE407) + b)


def _first_of_equal(same: np.ndarray, rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of sorted items (``same``: equal to the one before; in a group, places ascend)
    are late: under a larger id than the group's first, or again in one document."""
    if not len(same):
        return same
    group = np.cumsum(~same) - 1
    again = same & np.concatenate(([False], doc[1:] == doc[:-1]))
    return again | (rank > rank[np.flatnonzero(~same)][group])


class Batch:
    """The texts of one batch, in id order, and what its passes read off them."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows.column("id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()
        docs = sorted(zip(ids, texts), key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0, d[1] or b""))
        self.ids = [d[0] for d in docs]
        self.texts = [d[1] or b"" for d in docs]
        self.rank = np.cumsum([k > 0 and a != self.ids[k - 1] for k, a in enumerate(self.ids)]) if docs else np.empty(0, int)
        self.first = np.cumsum([0, *map(len, self.texts)])
        self._contexts()

    def blocks(self):
        """(first byte, 50-byte buckets, string starts inside documents, their anchors) of some documents at a time."""
        k = 0
        while k < len(self.texts):
            end, size = k, 0
            while end < len(self.texts) and (size < BLOCK or end == k):
                size += len(self.texts[end])
                end += 1
            if size >= WINDOW:
                data = np.frombuffer(b"".join(self.texts[k:end]), np.uint8)
                b50 = refine(initial_buckets(data), GRAM)
                lengths = np.diff(self.first[k:end + 1])
                starts = spread((self.first[k:end] - self.first[k])[lengths >= WINDOW], lengths[lengths >= WINDOW] - WINDOW + 1)
                if len(starts):
                    yield int(self.first[k]), b50, starts, anchors(b50)[starts]
            k = end

    def _contexts(self) -> None:
        """Contexts sorted by (anchor identifier, context identifier); ``entry`` numbers the distinct ones."""
        found = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for first, b50, starts, anchor in self.blocks():
            cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(starts) != 1)) + 1
            one, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut, [len(starts)])) - 1]
            ends = [_mix(b50[s], b50[s + ANCHOR]) for s in (one, last)]  # 100-byte buckets that cover the context
            # anchors are small identifiers by choice: mixed again, they fill the ranges evenly
            found.append((_finish(b50[anchor[np.concatenate(([0], cut))]]),
                          _mix(_mix(*ends), (last - one).astype(np.uint64)) >> np.uint64(64 - CONTEXT_BITS), one + first, last + first))
        anchor, context, one, last = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((context, anchor))
        self.anchor, self.context, self.one, self.last = anchor[order], context[order], one[order], last[order]
        self.doc = np.searchsorted(self.first, self.one, side="right") - 1
        same = np.concatenate(([False], (self.anchor[1:] == self.anchor[:-1]) & (self.context[1:] == self.context[:-1])))[:len(order)]
        self.entry = np.cumsum(~same) - 1
        self.entry_at = np.flatnonzero(~same)
        self.gone = _first_of_equal(same, self.rank[self.doc], self.doc)

    def strings(self, flags: np.ndarray) -> None:
        """Refine the unresolved contexts to 100-byte buckets and sort their strings."""
        flag = flags[self.entry] if len(self.entry) else np.empty(0, np.uint8)
        self.whole = self.gone | (flag == GONE)
        live = np.flatnonzero(~self.whole & (flag == REFINE))
        live = live[np.argsort(self.one[live])]
        one, n = self.one[live], self.last[live] - self.one[live] + 1
        self.at = spread(one, n)
        if len(live):
            data = np.frombuffer(b"".join(self.texts), np.uint8)[spread(one, n + WINDOW - 1)]
            size = n + WINDOW - 1
            bucket = refine(refine(initial_buckets(data), GRAM), ANCHOR)[spread(np.cumsum(size) - size, n)]
        else:
            bucket = np.empty(0, np.uint64)
        order = np.argsort(bucket, kind="stable")  # places ascend within a bucket, and so do ids
        self.at, self.bucket = self.at[order], bucket[order]
        self.at_doc = np.searchsorted(self.first, self.at, side="right") - 1
        same = np.concatenate(([False], self.bucket[1:] == self.bucket[:-1]))[:len(order)]
        self.late = _first_of_equal(same, self.rank[self.at_doc], self.at_doc)


def _senders(batch: Batch, doc: np.ndarray) -> tuple[list, bytes]:
    """(ids of the documents, their numbers among these)."""
    used, local = np.unique(doc, return_inverse=True)
    kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
    return [batch.ids[k] for k in used.tolist()], local.astype(kind).tobytes()


def _released(run):
    """``run`` one group at a time, memory given back after each."""
    if len(inspect.signature(run).parameters) == 1:
        def one(rows: pa.Table) -> pa.Table:
            out = run(rows)
            release()
            return out
        return one

    def two(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = run(rows, found)
        release()
        return out
    return two


def _pack_contexts(schema: pa.Schema, n_ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        batch, out = Batch(rows), []
        at = batch.entry_at
        anchor, context, doc = batch.anchor[at], batch.context[at], batch.doc[at]
        cuts, number = _ranges(anchor, n_ranges), rows.column("batch")[0].as_py()
        for r in range(n_ranges):
            if (n := int(cuts[r + 1] - cuts[r])):
                own = slice(cuts[r], cuts[r + 1])
                ids, local = _senders(batch, doc[own])
                short = np.ascontiguousarray(context[own].view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BITS // 8])
                out.append((r, number, n, ids, None, local + short.tobytes() + _pack_sorted(anchor[own])))
        del batch, anchor, context, doc
        return _table(out, schema)
    return _released(run)


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _sent(rows: pa.Table, extra: int):
    """(sorted identifiers, ``extra`` bytes of each, sender of each, (row, id) by sender, rank by sender) of a range."""
    keys, more, sender, ids = [], [], [], []
    for k, (own, n, data) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("ids", "n", "data")))):
        kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
        at = n * np.dtype(kind).itemsize
        sender.append(np.frombuffer(data[:at], kind).astype(np.int64) + len(ids))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :extra] = np.frombuffer(data[at:at + n * extra], np.uint8).reshape(n, extra)
        more.append(wide.view(np.uint64).ravel())
        keys.append(_unpack_sorted(data[at + n * extra:], n))
        ids += [(k, i) for i in own]
    distinct = sorted({i for _, i in ids if i is not None})
    place = {i: k for k, i in enumerate(distinct)}
    rank = np.fromiter((place.get(i, len(distinct)) for _, i in ids), np.int64, len(ids))
    return np.concatenate(keys), np.concatenate(more), np.concatenate(sender), ids, rank


def _count_contexts(schema: pa.Schema):
    """One anchor range: what each batch's contexts come to, in the order they were sent."""
    def run(rows: pa.Table) -> pa.Table:
        anchor, context, sender, _, rank = _sent(rows, CONTEXT_BITS // 8)
        rank = rank[sender]
        order = np.lexsort((context, anchor))
        a, c = anchor[order], context[order]
        new_anchor = np.concatenate(([True], a[1:] != a[:-1]))
        new = new_anchor | np.concatenate(([True], c[1:] != c[:-1]))
        first = np.flatnonzero(new)
        late = rank[order] > np.repeat(np.minimum.reduceat(rank[order], first), np.diff(np.append(first, len(a))))
        contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))
        several = np.repeat(contexts > 1, np.diff(np.append(np.flatnonzero(new_anchor), len(a))))
        flags = np.empty(len(a), np.uint8)
        flags[order] = np.where(late, GONE, np.where(several, REFINE, 0))
        n = rows.column("n").to_pylist()
        out = zip(rows.column("batch").to_pylist(), rows.column("range").to_pylist(), [None] * len(n), [None] * len(n),
                  [x.tobytes() for x in np.split(flags, np.cumsum(n)[:-1])])
        return _table(list(out), schema)
    return run


def _flags(found: pa.Table) -> np.ndarray:
    """The flags of a batch's contexts, put together by range."""
    rows = sorted((r, data) for r, data in zip(found.column("range").to_pylist(), found.column("data").to_pylist()) if r >= 0)
    return np.frombuffer(b"".join(data for _, data in rows), np.uint8)


def _pack_strings(schema: pa.Schema, n_ranges: int):
    """The first of equal strings of a batch's unresolved contexts, by identifier range."""
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if len(rows):
            batch = Batch(rows)
            batch.strings(_flags(found))
            bucket, doc = batch.bucket[~batch.late], batch.at_doc[~batch.late]
            cuts, number = _ranges(bucket, n_ranges), rows.column("batch")[0].as_py()
            for r in range(n_ranges):
                if (n := int(cuts[r + 1] - cuts[r])):
                    ids, local = _senders(batch, doc[cuts[r]:cuts[r + 1]])
                    out.append((r, number, n, ids, None, local + _pack_sorted(bucket[cuts[r]:cuts[r + 1]])))
        return _table(out, schema)
    return _released(run)


def _count_strings(schema: pa.Schema):
    """One identifier range: the smallest id of each string keeps it, the others get it
    back (one packed row per batch)."""
    def run(rows: pa.Table) -> pa.Table:
        bucket, _, sender, ids, rank = _sent(rows, 0)
        rank = rank[sender]
        order = np.argsort(bucket)
        bucket, rank, sender = bucket[order], rank[order], sender[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        late = rank > np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(bucket))))
        bucket, sender = bucket[late], sender[late]
        order = np.argsort(sender, kind="stable")  # senders ascend by row
        bucket, sender = bucket[order], sender[order]
        batches, by_row, at = rows.column("batch").to_pylist(), {}, 0
        for k, n in zip(*(x.tolist() for x in np.unique(sender, return_counts=True))):
            own = by_row.setdefault(ids[k][0], ([], [], []))
            own[0].append(ids[k][1])
            own[1].append(n)
            own[2].append(bucket[at:at + n].tobytes())
            at += n
        return _table([(batches[k], -1, own, n, b"".join(data)) for k, (own, n, data) in by_row.items()], schema)
    return run


def _cut(schema: pa.Schema):
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        batch = Batch(rows)
        batch.strings(_flags(found))
        sent: dict = {}
        for r, ids, counts, data in zip(*(found.column(c).to_pylist() for c in ("range", "ids", "counts", "data"))):
            at = 0
            for i, n in zip(ids, counts) if r < 0 else ():
                sent.setdefault(i, []).append(data[at:at + 8 * n])
                at += 8 * n
        bad = batch.late.copy()
        if sent:
            by_doc = np.argsort(batch.at_doc, kind="stable")
            cuts = np.searchsorted(batch.at_doc[by_doc], np.arange(len(batch.ids) + 1))
            for k, i in enumerate(batch.ids):
                if i in sent and cuts[k] < cuts[k + 1]:
                    own = by_doc[cuts[k]:cuts[k + 1]]
                    bad[own] |= np.isin(batch.bucket[own], np.frombuffer(b"".join(sent[i]), np.uint64))
        edge = np.zeros(int(batch.first[-1]) + 1, np.int32)
        np.add.at(edge, np.concatenate((batch.one[batch.whole], batch.at[bad])), 1)
        np.add.at(edge, np.concatenate((batch.last[batch.whole], batch.at[bad])) + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for k, (i, text) in enumerate(zip(batch.ids, batch.texts)):
            own = gone[batch.first[k]:batch.first[k + 1]]
            if not own.any():
                out.append((i, len(text), 0, [], text))
                continue
            spans = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])))).reshape(-1, 2).tolist()
            out.append((i, len(text), int(own.sum()), [{"start": s, "end": e} for s, e in spans],
                        np.frombuffer(text, np.uint8)[~own].tobytes()))
        return _table(out, schema)
    return _released(run)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, spans (maximal removed byte
    intervals, end exclusive) and kept (the other bytes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    n = shuffle_width(docs.sparkSession)
    source = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(BATCHES * n)).alias("batch"), F.col(id_col).alias("id"),
                         F.col(text_col).alias("text"))
    id_field = T.StructField("id", source.schema["id"].dataType)
    longs = {c: T.StructField(c, T.LongType()) for c in ("range", "batch", "n", "n_bytes", "n_removed")}
    ids, counts = T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("counts", T.ArrayType(T.LongType()))
    data = T.StructField("data", T.BinaryType())
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    packed = T.StructType([longs["range"], longs["batch"], longs["n"], ids, counts, data])
    answer = T.StructType([longs["batch"], longs["range"], ids, counts, data])
    result = T.StructType([id_field, longs["n_bytes"], longs["n_removed"], T.StructField("spans", T.ArrayType(span)),
                           T.StructField("kept", T.BinaryType())])
    by_batch = source.groupBy("batch")
    contexts = (by_batch.applyInArrow(_pack_contexts(to_arrow_schema(packed), n), packed)
                .groupBy("range").applyInArrow(_count_contexts(to_arrow_schema(answer)), answer))
    strings = (by_batch.cogroup(contexts.groupBy("batch"))
               .applyInArrow(_pack_strings(to_arrow_schema(packed), n), packed))
    decided = strings.groupBy("range").applyInArrow(_count_strings(to_arrow_schema(answer)), answer)
    cut = by_batch.cogroup(contexts.unionByName(decided).groupBy("batch")).applyInArrow(_cut(to_arrow_schema(result)), result)
    return cut.withColumnRenamed("id", id_col)
