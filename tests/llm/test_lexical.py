"""Operator 11 against brute force over all documents; the treap against dense sums."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from prepark.llm import lexical
from prepark.llm.catalog import QUERIES
from paths import SF001

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=10):
    held = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    total, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        found = []
        for (d, c), n in zip(held, sizes):
            score = 0
            for t in set(words(text)) & set(c):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (100 - 90 + (90 * n * total) // length)))
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0, d))
        rows += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


@pytest.mark.parametrize("seed", range(4))
def test_treap_gives_the_largest_sums(seed):
    rng = np.random.default_rng(seed)
    grid = rng.integers(1, 50, (37, 301)) * (rng.random((37, 301)) < 0.15)
    r, c = grid.nonzero()
    tree = lexical.K2Treap(r, c, grid[r, c])
    names = [(True, lexical.Descending(x), x) for x in range(301)]
    for own in ([0], [3, 5, 8], list(range(37))):
        best = []
        scored = tree.search(np.array(own), names, best, 10)
        sums = grid[own].sum(axis=0)
        want = sorted(((-int(s), x) for x, s in enumerate(sums) if s > 0))[:10]
        assert sorted((-e[0], e[2].value) for e in best) == want
        assert scored <= 301


def test_treap_leaves_weak_ranges_shut():
    n = 4096
    impact = np.ones(n, np.int64)
    impact[700:712] = 1000
    tree = lexical.K2Treap(np.zeros(n, np.int64), np.arange(n), impact)
    best = []
    assert tree.search(np.array([0]), [(True, lexical.Descending(x), x) for x in range(n)], best, 10) <= 2 * lexical.OPEN
    assert {e[2].value for e in best} <= set(range(700, 712))


def test_edges(spark, make_docs, edge_rows):
    docs = [*edge_rows, (20, "The QUICK Émile_fox's 42"), (21, "émile Émile"), (None, "quick quick"), (22, "quick quick"), (22, "quick quick")]
    items = [(1, "quick brown fox 12345 émile"), (2, "Émile"), (3, ""), (4, None), (1, "river river bank"), (None, "quick"), (6, "nowhere")]
    df = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    assert rows_of(lexical.search(make_docs(docs), df)) == brute(docs, items)
    assert rows_of(lexical.search(make_docs(docs), df, k=2)) == brute(docs, items, 2)
    assert rows_of(lexical.search(make_docs([]), df)) == []
    assert rows_of(lexical.search(make_docs(docs), df.limit(0))) == []


def test_blocks_of_items_documents_and_text(spark, make_docs, monkeypatch):
    docs = [(k, " ".join(f"w{(k * j) % 37}" for j in range(1, 2 + k % 23))) for k in range(400)]
    items = [(k, f"w{k} w{k + 1} w{2 * k} w5") for k in range(12)]
    for name, value in (("BLOCK_TERMS", 9), ("BLOCK_DOCS", 31), ("BLOCK_POINTS", 200), ("SLICE", 11), ("OPEN", 3)):
        monkeypatch.setattr(lexical, name, value)
    df = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    assert rows_of(lexical.search(make_docs(docs), df)) == brute(docs, items)


def test_query_on_the_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(QUERIES["op11_k2treap_search"](spark, SF001)) == brute(docs, items)
