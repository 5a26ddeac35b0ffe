"""Operator 12 against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

from prepark.llm import variants
from prepark.llm.catalog import QUERIES
from paths import SF001


def brute_words(docs, every=199):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and every:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_forms(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return rows


def rows_of(df):
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_forms_against_all_pairs(spark):
    words = {"banana": 500, "bananna": 40, "banannas": 6, "bananas": 90, "banaana": 5, "canana": 500, "aaaaaa": 9, "aaaaaaa": 60,
             "aaaaaaaa": 9, "éaaaaaa": 5, "ÿanana": 7, "zebras": 3000, "zebra": 4, "zebrass": 599, "zebrasss": 100, "xyxyxy": 5, "yxyxyx": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(variants.with_roots(variants.variant_forms(df)))
    assert got == brute_forms(words)
    assert {r[0]: r[2] for r in got}["zebrasss"] == "zebras"  # over zebrass


def test_words_with_the_terminator_and_nulls(spark):
    df = spark.createDataFrame([("a\u0000bcdef", 9), ("abcdef", 9), (None, 9)], "word string, n long")
    assert {(r.word, r.n_near) for r in variants.variant_forms(df).collect()} == {("a\u0000bcdef", 0), ("abcdef", 0)}


def test_texts_with_edges(spark, make_docs, edge_rows):
    docs = [*edge_rows, *[(100 + k, "Straße ÉCOLE école colour color's colours Colourss " * 6) for k in range(40)],
            *[(300 + k, "colour") for k in range(90)]]
    got = rows_of(variants.spelling_variants(make_docs(docs), spoil_every=3))
    assert got == brute_forms(brute_words(docs, 3))
    assert any(r[1] for r in got)
    assert rows_of(variants.spelling_variants(make_docs([]), spoil_every=3)) == set()


def test_slices_keep_runs_whole(monkeypatch):
    text = "Überlänge wörter ABCDEFGHIJKLMNOP " * 20
    monkeypatch.setattr(variants, "SLICE", 7)
    assert [w for part in variants.runs(text) for w in part] == re.findall("[a-zÀ-ÿ]+", text.replace("ABCDEFGHIJKLMNOP", "abcdefghijklmnop"))


def test_query_on_the_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(docs)
    assert rows_of(QUERIES["op12_permuterm_variants"](spark, SF001)) == brute_forms(words)
    assert len(words) > 300
