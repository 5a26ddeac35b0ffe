"""Operator 4 against brute force over word sequences."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from prepark.llm import windows
from prepark.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    big = lambda i: (i is None, i or 0)
    low, out = {}, []
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            low[key] = min(low.get(key, (True, 1)), big(i))
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if low[tuple(w[k:k + width])] < big(i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()], key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op4_matches_brute_force(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = sorted([tuple(r) for r in QUERIES["op4_window_dedup"](spark, sf).collect()], key=str)
    assert got == sorted([(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows)], key=str)
    assert sum(g for _, _, g, _ in got) > 0


def test_edge_rows(spark, make_docs, edge_rows):
    assert result(windows.window_dedup(make_docs(edge_rows))) == brute(edge_rows)
    assert windows.window_dedup(make_docs([(1, "a")]).limit(0)).count() == 0


def test_shared_passages_over_batches_and_partitions(spark, make_docs, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    passages = [list(rng.choice(words, 30)) for _ in range(6)]
    rows = []
    for k in range(300):
        body = list(rng.choice(words, rng.integers(0, 40)))
        for p in rng.integers(0, 6, rng.integers(0, 4)):
            body += passages[p] + list(rng.choice(words, 5))
        rows.append((int(rng.integers(0, 250)) if k % 11 else None, " ".join(body)))
    want = brute(rows, 5)
    for parts in (1, 7):
        assert result(windows.window_dedup(make_docs(rows, parts), width=5)) == want


def test_spans_are_maximal(spark, make_docs):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(1, text), (2, "x y " + text + " z"), (3, " ".join(f"a{k}" for k in range(5, 20)) + " q")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in windows.window_dedup(make_docs(rows)).collect()}
    assert got == {1: [], 2: [(2, 42)], 3: [(0, 15)]}


def test_packed_hashes_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        assert (windows._unpack_sorted(windows._pack_sorted(h), len(h)) == h).all()
    dense = np.arange(10, 500, 3).astype(np.uint64)
    assert (windows._unpack_sorted(windows._pack_sorted(dense), len(dense)) == dense).all()
