"""Ranked lexical search over a K2-treap of the term-document grid (operator 11).

The grid has a row per term and a column per document; a point holds the impact of
the term in the document (its part of the score, an integer). Each task keeps the
documents it reads as blocks of columns and builds a K2-treap of each: a quadtree in
which a cell says by four bits which quarters are not empty and holds the largest
impact inside. An item descends the paths of all its rows at once: a range of
documents has one cell per row of the item, the sum of their maxima bounds every
score in the range, and the ranges are opened best first until no bound reaches the
score of the item's k-th document. The best of a task's blocks are carried from block
to block, the best of all tasks meet in a top-k per item.

Only the rows of the items' terms are needed, so items are dealt in blocks of at most
``BLOCK_TERMS`` distinct terms (an item with more is a block of its own); the terms of
a block go to the tasks, the documents never move. One pass reads the texts and writes
the counts of a block's terms, a second one reads those counts.

Nulls: a null text or item has no term, and a null item no row; a null doc_id or
item_id is kept, a null doc_id ranks after all ids of its score. Equal ids are separate
documents (items), each with rows of its own. Empty texts and tables give no row. Long
texts are cut into slices between terms. Ties rank by ascending doc_id.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_scratch

#: a term is a run of anything but these, once A-Z is lower-cased
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SLICE = 1 << 20
BLOCK_TERMS = 1 << 16
#: documents (columns) of one K2-treap and points after which a block is closed
BLOCK_DOCS, BLOCK_POINTS = 1 << 14, 1 << 21
#: document ranges opened at once
OPEN = 64

_QUARTERS = np.array([bin(m).count("1") for m in range(16)], np.int32)


def terms(text: str | None) -> Iterator[list[str]]:
    """The terms of a text, slice by slice (``bytes.lower`` lowers A-Z only)."""
    at, text = 0, text or ""
    while at < len(text):
        end = at + SLICE
        low = text[at:end].encode().lower().decode()
        while end < len(text) and (m := TERM.match(text[end:end + SLICE].encode().lower().decode())):
            low += m[0]
            end += m.end()
        at = end
        yield TERM.findall(low)


class K2Treap:
    """Largest impact of every cell of a quadtree over rows x columns.

    ``rows``, ``cols`` and ``impact`` list the points, at most one per place. Level 0 is
    the whole grid, level ``height`` the points. Per level: ``mask`` (which quarters hold
    a point), ``first`` (where the first of them is on the next level) and ``most``. The
    last entry of each array is the empty cell."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, impact: np.ndarray):
        side = max(int(rows.max(initial=0)), int(cols.max(initial=0))) + 1
        self.height = max(1, (side - 1).bit_length())
        code = np.zeros(len(rows), np.int64)  # row and column bits in turn: sorted, the quarters of a cell are neighbours
        for b in range(self.height):
            code |= ((rows.astype(np.int64) >> b) & 1) << (2 * b + 1) | ((cols.astype(np.int64) >> b) & 1) << (2 * b)
        order = np.argsort(code, kind="stable")
        code, most = code[order], impact[order].astype(np.int64)
        self.mask, self.first, self.most = [], [], [np.append(most, 0)]
        for _ in range(self.height):
            up, start = np.unique(code >> 2, return_index=True)
            bits = np.left_shift(1, code & 3).astype(np.uint8)
            self.mask.append(np.append(np.bitwise_or.reduceat(bits, start), 0).astype(np.uint8) if len(up) else np.zeros(1, np.uint8))
            self.first.append(np.append(start, 0).astype(np.int32))
            most = np.maximum.reduceat(most, start) if len(up) else most
            self.most.append(np.append(most, 0))
            code = up
        for levels in (self.mask, self.first, self.most):
            levels.reverse()

    def quarter(self, level: int, cells: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The cells' quarters ``q`` on the next level; -1, the empty cell, if they hold nothing."""
        mask = self.mask[level][cells]
        at = self.first[level][cells] + _QUARTERS[mask & ((1 << q) - 1)]
        return np.where((mask >> q) & 1, at, -1)

    def search(self, rows: np.ndarray, names: list, best: list, k: int) -> int:
        """Put the columns of largest summed impact over ``rows`` into ``best``, a heap of
        (score, *name of the column) of k at most. Returns how many columns were scored."""
        h, scored = self.height, 0
        ranges: list[list] = [[] for _ in range(h + 1)]  # per level: (bounds, columns, cells), best range first
        ranges[0].append((np.array([self.most[0][0] * len(rows)]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)))
        while True:
            level = max((x for x in range(h + 1) if ranges[x]), key=lambda x: (max(r[0][0] for r in ranges[x]), x), default=None)
            if level is None:
                return scored
            bounds, cols, cells = max(ranges[level], key=lambda r: r[0][0])
            ranges[level] = [r for r in ranges[level] if r[0] is not bounds]
            least = max(1, best[0][0]) if len(best) == k else 1
            alive = int(np.searchsorted(-bounds, -least, side="right"))  # equal scores may rank higher by their id
            if not alive:
                continue
            if level == h:
                scored += alive
                for score, col in zip(bounds[:alive].tolist(), cols[:alive].tolist()):
                    entry = (score, *names[col])
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                continue
            if alive > OPEN:
                ranges[level].append((bounds[OPEN:alive], cols[OPEN:alive], cells[OPEN:alive]))
            cells, cols = cells[:OPEN][:alive], cols[:OPEN][:alive]
            bit = (rows >> (h - 1 - level)) & 1
            halves = [self.quarter(level, cells, 2 * bit + side) for side in (0, 1)]
            below = np.concatenate(halves)
            bounds = self.most[level + 1][below].sum(axis=1)
            cols = np.concatenate([2 * cols, 2 * cols + 1])
            order = np.argsort(-bounds, kind="stable")
            order = order[:int(np.count_nonzero(bounds >= least))]
            if len(order):
                ranges[level + 1].append((bounds[order], cols[order], below[order]))


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[list[str]]]]:
    """(item_ids, terms of each) of some items, ``BLOCK_TERMS`` distinct terms together."""
    ids: list = []
    lists: list[list[str]] = []
    known: set[str] = set()
    for row in items.select("item_id", "text").toLocalIterator():
        own = {t for part in terms(row.text) for t in part}
        if ids and len(known | own) > BLOCK_TERMS:
            yield ids, lists
            ids, lists, known = [], [], set()
        if own:
            ids.append(row.item_id)
            lists.append(sorted(own))
            known |= own
    if ids:
        yield ids, lists


def term_points(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """(doc_id, n, term, tf): every document, its terms in all, and which of ``number``
    it holds how often (lists of equal length)."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for rows in batches:
            sizes, term, tf = [], [], []
            for text in rows.column(1).to_pylist():
                n, held = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    held.update(t for t in map(number.get, part) if t is not None)
                sizes.append(n)
                term.append(list(held.keys()))
                tf.append(list(held.values()))
            yield pa.record_batch({"doc_id": rows.column(0), "n": pa.array(sizes, pa.int64()),
                                   "term": pa.array(term, pa.list_(pa.int32())), "tf": pa.array(tf, pa.list_(pa.int64()))})

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "text").mapInArrow(count, schema)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, words: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)), m = 100 - 90 + ((90 n N) div L)."""
    m = 100 - 90 + (90 * n * docs) // words
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _search_block(docs: DataFrame, ids: list, lists: list[list[str]], k: int) -> DataFrame:
    """(item, doc_id, score) with the k best documents of each item that each task read."""
    spark = docs.sparkSession
    number = {t: x for x, t in enumerate(sorted({t for own in lists for t in own}))}
    points = write_scratch(term_points(docs, number), "lexical-points")
    held = points.select(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words")).first()
    frequency = np.zeros(len(number), np.int64)
    for r in points.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # BLOCK_TERMS rows at most
        frequency[r["term"]] = r["count"]
    total = held.docs
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)
    row_of = np.empty(len(number), np.int64)  # terms of like frequency share cells, so a cell's maximum fits its rows
    row_of[np.argsort(frequency, kind="stable")] = np.arange(len(number))
    paths = [row_of[[number[t] for t in own]] for own in lists]
    shared = spark.sparkContext.broadcast((weight, row_of, paths, total, max(1, held.words or 0)))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, row_of, paths, total, words = shared.value
        best: list[list] = [[] for _ in paths]
        kind = None

        def search(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows).combine_chunks()
            own = table.column("doc_id").to_pylist()
            n = table.column("n").to_numpy()
            lists = table.column("term").combine_chunks()
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            term = lists.flatten().to_numpy()
            tf = table.column("tf").combine_chunks().flatten().to_numpy()
            by_size = np.argsort(n, kind="stable")  # short documents have the large impacts: keep them together
            col = np.empty(len(n), np.int64)
            col[by_size] = np.arange(len(n))
            at = np.repeat(np.arange(len(n)), count)
            # a null id ranks last; the number breaks ties between equal ids
            names = [(own[d] is not None, Descending(own[d]), d) for d in by_size.tolist()]
            tree = K2Treap(row_of[term], col[at], impacts(tf, n[at], weight[term], total, words))
            for rows_of_item, heap in zip(paths, best):
                tree.search(rows_of_item, names, heap, k)

        block, docs_held, points_held = [], 0, 0
        for rows in batches:
            kind = rows.schema.field("doc_id").type
            rows = rows.filter(pc.greater(pc.list_value_length(rows.column("term")), 0))
            for start in range(0, rows.num_rows, BLOCK_DOCS):
                part = rows.slice(start, BLOCK_DOCS)
                held = len(part.column("term").flatten())
                if block and (docs_held + part.num_rows > BLOCK_DOCS or points_held + held > BLOCK_POINTS):
                    search(block)
                    block, docs_held, points_held = [], 0, 0
                block.append(part)
                docs_held, points_held = docs_held + part.num_rows, points_held + held
        if block:
            search(block)
        if kind is not None:
            found = [(item, e[2].value, e[0]) for item, heap in enumerate(best) for e in heap]
            yield pa.record_batch({"item": pa.array([f[0] for f in found], pa.int32()), "doc_id": pa.array([f[1] for f in found], kind),
                                   "score": pa.array([f[2] for f in found], pa.int64())})

    schema = T.StructType([T.StructField("item", T.IntegerType()), points.schema["doc_id"], T.StructField("score", T.LongType())])
    return points.select("doc_id", "n", "term", "tf").mapInArrow(best_of, schema)


class Descending:
    """Turns an id's order round: of equal scores the smallest id is the best."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return self.value is not None and other.value is not None and other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of ``docs`` (doc_id, text) for each row of
    ``items`` (item_id, text), scores above 0 only."""
    spark = docs.sparkSession
    id_field = T.StructField("item_id", items.schema["item_id"].dataType)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = []
    for ids, lists in item_blocks(items):
        found = _search_block(docs, ids, lists, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), id_field]))
        out.append(write_scratch(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical-found"))
    if not out:
        empty = T.StructType([id_field, T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    first, *rest = out
    for other in rest:
        first = first.unionByName(other)
    return first
