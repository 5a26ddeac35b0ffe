"""1. SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: 64-bit SimHash of the word shingles (repeats count), each
shingle hashed with XXH64. Equal fingerprints collapse to one class before any
search. Two classes link when their fingerprints differ in at most
``max_bits`` bits.

Search. The 64 bits are cut into ``max_bits + 1`` blocks; two linked
fingerprints agree on one block at least, hence on its high bits, so each class
is dealt to one bucket per block (a lossless partition of the search). Only so
many high bits are taken that a bucket holds some thousand fingerprints
(``BUCKET``); within it the Gray tree does the search. Buckets are sorted by Gray
rank over the whole cluster, so a bucket of any size spreads over tasks. Runs
of consecutive Gray ranks form nodes: a node keeps the bits all its members
share (``fixed`` mask and ``value``), its children only add the bits shared
beyond their parent's, and a query is dropped from a whole group as soon as the
differences accumulated on the way down exceed ``max_bits``. A bucket longer
than ``WHOLE`` fingerprints, or cut by a partition's edge, is stored as nodes of
``NODE`` and searched group against group: groups of ``NODES`` nodes first, then the
nodes of the groups left, each time pruned by the bits that both sides fix; only
pairs of nodes left at the end meet with their members.

Each search step returns a spanning star of what it linked, not the pairs, so
the links of a dense group stay linear in its size; components follow by
contraction.

Null, empty and blank texts have no shingles: fingerprint zero, linked like
any other. A text with fewer words than a shingle is one shingle. Rows are
kept one to one: repeated rows give repeated results. A null id never names a
component; a component of null ids only has a null ``component_id``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_scratch
from .common import connected_components, fresh, shuffle_width, words_of

BUCKET = 2048
WHOLE = 8192
NODE = 512
NODES = 64
FANOUT = 4
QUERIES = 512


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter([h64(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist())], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded unpacking for very long texts
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, fold: bool):
    @F.pandas_udf(T.LongType())
    def fp(text: pd.Series) -> pd.Series:
        data = (t.encode() if isinstance(t, str) else b"" for t in text)
        got = [fingerprint(t.lower() if fold else t, shingle) for t in data]  # bytes.lower changes A-Z only
        return pd.Series(np.array(got, np.uint64).view(np.int64))
    return fp


def gray_rank(code):
    """Rank of a 64-bit Gray code as a column, ordered as a signed long."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _shared(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fixed, value) of each run of ``size`` consecutive codes."""
    at = np.arange(0, len(codes), size)
    every, some = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
    fixed = ~(every ^ some)
    return fixed, every & fixed


def _descend(queries: np.ndarray, first: int, codes: np.ndarray, levels: list, max_bits: int, later: bool):
    """(query, code) pairs found, and how many codes were compared one by one."""
    size, fixed, value, _ = levels[0]
    q = np.repeat(np.arange(len(queries)), len(value))
    node = np.tile(np.arange(len(value)), len(queries))
    acc = np.zeros(len(q), np.int64)
    for k, (size, _, value, own) in enumerate(levels):
        if later:  # a pair is met once, from its earlier code
            live = (node + 1) * size > q + first + 1
            q, node, acc = q[live], node[live], acc[live]
        compared = len(q)
        acc = acc + np.bitwise_count((queries[q] ^ value[node]) & own[node])
        live = acc <= max_bits
        q, node, acc = q[live], node[live], acc[live]
        if size > 1:
            q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            live = node < len(levels[k + 1][2])
            q, node, acc = q[live], node[live], acc[live]
    return q + first, node, compared


def gray_search(queries: np.ndarray, codes: np.ndarray, max_bits: int, later: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs (query, code) that differ in at most ``max_bits`` bits, and the number of
    codes compared one by one. ``codes`` are in Gray order; queries descend the tree of
    shared masked patterns, some at a time. ``later``: the queries are the codes, and
    only pairs of a code and a later one are wanted."""
    size = FANOUT
    while size * FANOUT < len(codes):
        size *= FANOUT
    levels, above = [], None
    while size >= 1:
        fixed, value = _shared(codes, size) if size > 1 else (np.full(len(codes), ~np.uint64(0)), codes)
        # only the bits that this level fixes beyond its parent's are compared
        own = fixed if above is None else fixed & ~above[np.arange(len(fixed)) // FANOUT]
        levels.append((size, fixed, value, own))
        size, above = size // FANOUT, fixed
    if not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    found = [_descend(queries[k:k + QUERIES], k, codes, levels, max_bits, later) for k in range(0, len(queries), QUERIES)]
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found))


def gray_links(queries: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``gray_search`` without the count."""
    return gray_search(queries, codes, max_bits)[:2]


def _star(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search_runs(max_bits: int):
    """Over partitions sorted by (bucket, Gray rank): star edges inside each node,
    and the nodes of buckets that don't end within one node."""

    def emit(bucket: int, codes: np.ndarray, whole: bool):
        i, j, _ = gray_search(codes, codes, max_bits, later=True)
        label = _star(len(codes), i, j)
        linked = label != np.arange(len(codes))
        edges = [("edge", int(a), int(b), None, None, None, None)
                 for a, b in zip(codes[linked].view(np.int64), codes[label[linked]].view(np.int64))]
        if not whole:
            fixed, value = _shared(codes, len(codes))
            edges.append(("node", None, None, bucket, int(fixed.view(np.int64)[0]), int(value.view(np.int64)[0]),
                          codes.view(np.int64).tolist()))
        return edges

    def run(batches):
        buckets, codes, first = np.empty(0, np.int64), np.empty(0, np.uint64), True

        def pack(rows):
            cols = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                       pa.int64(), pa.list_(pa.int64())))],
                ["kind", "a", "b", "bucket", "fixed", "value", "members"])

        split = None  # the bucket of a run already cut into nodes
        for batch in batches:
            buckets = np.concatenate((buckets, batch.column("bucket").to_numpy()))
            codes = np.concatenate((codes, batch.column("fp").to_numpy().view(np.uint64)))
            rows = []
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            at = 0
            for end in cuts.tolist():  # complete runs
                bucket = int(buckets[at])
                alone = not first and split != bucket and end - at <= WHOLE
                if not (alone and end - at == 1):
                    step = WHOLE if alone else NODE
                    for k in range(at, end, step):
                        rows += emit(bucket, codes[k:min(k + step, end)], alone)
                first, at = False, end
            while len(codes) - at > WHOLE:  # a run too long for one search: cut it as it comes
                split = int(buckets[at])
                rows += emit(split, codes[at:at + NODE], False)
                first, at = False, at + NODE
            buckets, codes = buckets[at:], codes[at:]
            yield pack(rows)
        if len(codes):  # the last run may go on in the next partition
            yield pack([r for k in range(0, len(codes), NODE) for r in emit(int(buckets[0]), codes[k:k + NODE], False)])

    return run


def _search_pairs(max_bits: int):
    def run(batches):
        for batch in batches:
            left, right = [], []
            for x, y in zip(batch.column("members").to_pylist(), batch.column("others").to_pylist()):
                a, b = np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64)
                i, j = gray_links(a, b, max_bits)
                label = _star(len(a) + len(b), i, len(a) + j)
                both = np.concatenate((a, b)).view(np.int64)
                linked = label != np.arange(len(both))
                left.append(both[linked])
                right.append(both[label[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s) if s else np.empty(0, np.int64))
                                              for s in (left, right)], ["a", "b"])
    return run


def link_edges(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` (long) within
    ``max_bits`` bits: as many components as with every pair, fewer edges."""
    spark = classes.sparkSession
    blocks, at, buckets = max_bits + 1, 0, []
    taken = max(0, (classes.count() // BUCKET).bit_length() - 1)  # high bits of a block that name its bucket
    for k in range(blocks):
        width = (64 - at) // (blocks - k)
        bits = min(taken, width)
        named = F.shiftrightunsigned("fp", at + width - bits).bitwiseAND(F.lit((1 << bits) - 1))
        # a mixed key, so that bucket ranges are even even if a block's bits are not
        buckets.append(F.xxhash64(F.lit(k), named))
        at += width
    if not taken:  # few fingerprints: one bucket holds all
        buckets = buckets[:1]
    dealt = (classes.select("fp", gray_rank(F.col("fp")).alias("rank"), F.explode(F.array(*buckets)).alias("bucket"))
             .repartitionByRange(shuffle_width(spark), "bucket", "rank").sortWithinPartitions("bucket", "rank"))
    found = write_scratch(dealt.select("bucket", "fp").mapInArrow(
        _search_runs(max_bits), "kind string, a long, b long, bucket long, fixed long, value long, members array<long>"),
        "simhash-index")
    return found.filter("kind = 'edge'").select("a", "b").unionByName(_across(found.filter("kind = 'node'"), max_bits))


def _across(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Edges between the nodes of one bucket: groups of nodes against groups, then nodes
    against nodes, by their masks; members are joined to the pairs left."""
    first = F.col("members")[0]
    at = F.row_number().over(Window.partitionBy("bucket").orderBy(gray_rank(F.col("node")))) - 1
    masks = write_scratch(nodes.select("bucket", first.alias("node"), "fixed", "value")
                          .withColumn("grp", F.floor(at / NODES)), "simhash-nodes")  # a row a node, no members
    low, high = F.bit_and("value"), F.bit_or("value")
    groups = (masks.groupBy("bucket", "grp").agg(F.bit_and("fixed").alias("all"), low.alias("low"), high.alias("high"))
              .select("bucket", "grp", F.expr("all & ~(low ^ high)").alias("fixed"), F.expr("low & all & ~(low ^ high)").alias("value")))

    def other(side: DataFrame) -> DataFrame:
        return side.select("bucket", *[F.col(c).alias(f"{c}2") for c in side.columns if c != "bucket"])

    near = F.expr(f"bit_count((value ^ value2) & fixed & fixed2) <= {max_bits}")
    pairs = groups.join(other(groups), "bucket").filter(near & F.expr("grp <= grp2")).select("bucket", "grp", "grp2")
    pairs = (pairs.join(masks, ["bucket", "grp"]).join(other(masks), ["bucket", "grp2"])
             .filter(near & F.expr("grp < grp2 or node < node2")).select("bucket", "node", "node2"))
    held = nodes.select("bucket", first.alias("node"), "members")
    met = pairs.join(held, ["bucket", "node"]).join(
        held.select("bucket", F.col("node").alias("node2"), F.col("members").alias("others")), ["bucket", "node2"])
    return met.select("members", "others").mapInArrow(_search_pairs(max_bits), "a long, b long")


def _labelled(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, label, low): each distinct fingerprint's component, and the smallest id that has it."""
    classes = write_scratch(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    labels = connected_components(link_edges(classes, max_bits))
    return (classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", "low", F.coalesce("label", "fp").alias("label")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 2, fold: bool = True) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id (null ids last),
    then of the smallest text hash; of equal rows any one. The choice is an aggregate over
    (component, id, text hash), so a component of a third of the rows is summed up where
    it is read, and one row of each finds its way back by these keys."""
    key = {"id": fresh("id"), "h": fresh("h"), "row": fresh("row")}
    fps = write_scratch(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"),
                                    _fingerprints(shingle, fold)(F.col(text_col)).alias("fp")), "simhash-fp")
    named = fps.join(_labelled(fps, max_bits).select("fp", "label"), "fp")
    no_id = F.col("id").isNull()
    # first the smallest id, then the smallest hash of its texts: both are plain minima
    ids = named.groupBy("label").agg(F.min("id").alias("least"), F.min(F.when(no_id, F.col("h"))).alias("h0"))
    hashes = (named.filter(~no_id).groupBy("label", "id").agg(F.min("h").alias("h")).join(
        ids.filter("least is not null").select("label", F.col("least").alias("id")), ["label", "id"]).select("id", "h"))
    chosen = hashes.unionByName(ids.filter("least is null").select(F.lit(None).cast(fps.schema["id"].dataType).alias("id"), F.col("h0").alias("h")))
    chosen = chosen.select(F.col("id").alias(key["id"]), F.col("h").alias(key["h"]))
    kept = docs.withColumn(key["row"], F.xxhash64(F.col(text_col))).join(
        chosen, F.col(id_col).eqNullSafe(F.col(key["id"])) & (F.col(key["row"]) == F.col(key["h"])))
    # a text of its own is one component, so what is equal in id and text is one component's
    return kept.dropDuplicates([key["id"], key["h"]]).select(*docs.columns)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 2, fold: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id
    (smallest id reachable over links of at most ``max_bits`` differing bits).
    ``fold`` lower-cases A-Z first."""
    fps = write_scratch(docs.select(F.col(id_col).alias("id"), _fingerprints(shingle, fold)(F.col(text_col)).alias("fp")),
                        "simhash-fp")
    labelled = _labelled(fps, max_bits)
    groups = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    known = labelled.join(groups, "label").select("fp", "component_id")
    return fps.join(known, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")

