"""The pipeline against the brute-force versions of its stages."""

import duckdb
import zstandard

import corpus_pipeline
from prepark.llm import quality
from test_decontaminate import brute as brute_items
from test_lines import WORD
from test_simhash_quality import brute_groups, brute_report
from test_tokens import brute_bpe

SF = "/root/testdata/sf0.001"


def shared_ends(a, b):
    m = min(len(a), len(b))
    start = next((k for k in range(m) if a[k] != b[k]), m)
    end = next((k for k in range(m) if a[-1 - k] != b[-1 - k]), m)
    return start + end


def brute_lines(rows):
    first, out = {}, []
    for i, t in sorted(rows):
        for p, x in enumerate(t.split("\n")):
            if WORD.findall(x):
                first.setdefault(tuple(WORD.findall(x)), (i, p))
    best = dict(first)
    by_size = {}
    for w in first:
        by_size.setdefault(len(w), []).append(w)
    for w in first:
        for size in (len(w), len(w) + 1):
            for v in by_size.get(size, []) if size >= 5 else []:
                if v != w and shared_ends(w, v) >= size - 1:
                    best[w], best[v] = min(best[w], first[v]), min(best[v], first[w])
    for i, t in rows:
        kept = [x for p, x in enumerate(t.split("\n")) if not WORD.findall(x) or not best[tuple(WORD.findall(x))] < (i, p)]
        text = "\n".join(kept)
        if len(kept) == t.count("\n") + 1 or WORD.search(text):
            out.append((i, text))
    return out


def brute_stages(rows, items):
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rows = [(i, t) for i, t in rows if not brute_report(t)[-1] and quality.compression((t or "").encode(), compress)[3]]
    yield rows
    rows = brute_lines(rows)
    yield rows
    alone = {i for i, _, c in brute_groups(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in alone]
    yield rows
    found = {i for i, _ in brute_items(rows, items)}
    rows = [(i, t) for i, t in rows if i not in found]
    yield rows


def test_stages_match_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES, brute_stages(rows, items)):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    last = sorted((r.doc_id, r.n_tokens, r.ids, r.text) for r in corpus_pipeline.run(spark, SF).collect())
    assert last == sorted((i, len(brute_bpe(t)), brute_bpe(t), t) for i, t in want)
    assert 0 < len(last) < len(rows)


def test_stages_on_edge_rows(spark, edge_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, None, len(t) if t else None) for i, t in edge_rows], schema)
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns and out.count() <= some.count()
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == some.count()


def test_one_of_each_group_stays_whatever_the_ids(spark, make_docs):
    same = "the quick brown fox jumps over the lazy dog near the quiet river bank " * 4
    rows = [(None, same), (None, same), (None, same), (5, same), (5, same), (6, same), (None, "other words in a text that stands alone here"),
            (None, "other words in a text that stands alone here"), (9, "a third text"), (9, "a fourth one, of the same id"), (10, None), (None, None)]
    docs = make_docs(rows)
    got = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(5, same), (None, "other words in a text that stands alone here"), (9, "a third text"), (9, "a fourth one, of the same id"), (10, None)], key=str)
    assert corpus_pipeline.simhash_near_dedup(spark, make_docs([]), SF).count() == 0
