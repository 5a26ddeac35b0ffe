"""Operator 10 against brute force over all 100-byte strings."""

import hashlib

import duckdb
import numpy as np
import pytest

from prepark.llm import substrings
from prepark.llm.catalog import QUERIES


def brute(rows, width=100):
    big = lambda i: (i is None, i or 0)
    data = [(t or "").encode() for _, t in rows]
    low = {}
    for (i, _), b in zip(rows, data):
        for k in range(len(b) - width + 1):
            key = b[k:k + width]
            low[key] = min(low.get(key, (True, 1)), big(i))
    out = []
    for (i, _), b in zip(rows, data):
        gone, seen = np.zeros(len(b) + 1, bool), set()
        for k in range(len(b) - width + 1):
            key = b[k:k + width]
            if low[key] < big(i) or key in seen:
                gone[k:k + width] = True
            seen.add(key)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone.tolist()) if not g)
        out.append((i, len(b), int(gone[:len(b)].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
                   for r in df.collect()], key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op10_matches_brute_force(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = sorted([tuple(r) for r in QUERIES["op10_substring_dedup"](spark, sf).collect()], key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_edge_rows(spark, make_docs, edge_rows):
    assert result(substrings.substring_dedup(make_docs(edge_rows))) == brute(edge_rows)
    assert substrings.substring_dedup(make_docs([(1, "a")]).limit(0)).count() == 0


def test_copies_overlaps_and_runs(spark, make_docs):
    rng = np.random.default_rng(4)
    letters = np.array(list("ab é\n"))
    passages = ["".join(rng.choice(letters, rng.integers(90, 400))) for _ in range(8)]
    rows = []
    for k in range(150):
        body = ""
        for p in rng.integers(0, 8, rng.integers(0, 5)):
            at = int(rng.integers(0, 60))
            body += passages[p][at:] + "".join(rng.choice(letters, 7))
        rows.append((int(rng.integers(0, 130)) if k % 13 else None, body))
    rows += [(900, "z" * 500), (901, "z" * 99), (902, "z" * 100), (903, "xy" * 300), (904, "yx" * 60)]
    want = brute(rows)
    for parts in (1, 5):
        assert result(substrings.substring_dedup(make_docs(rows, parts))) == want


def test_blocks_do_not_change_the_result(spark, make_docs, monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abc"), 700)) for _ in range(20)]
    texts += [t[100:400] for t in texts[:10]]
    rows = pa.table({"batch": [0] * 30, "id": list(range(30)), "text": texts})
    got = []
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(substrings, "BLOCK", size)
        b = substrings.Batch(rows)
        b.strings(np.full(len(b.entry_at), substrings.REFINE, np.uint8))
        got.append((b.anchor.tolist(), b.context.tolist(), b.gone.tolist(), b.at.tolist(), b.late.tolist()))
    assert got[0] == got[1] == got[2]
