"""Operators 5 and 6 against the libraries on whole texts."""

import hashlib
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex

from prepark.llm import byte_bpe, token_files
from prepark.llm.catalog import QUERIES
from prepark.session import scratch_path

SF = "/root/testdata/sf0.001"


def texts_of(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


def brute_bpe(text):
    return byte_bpe._encoding(public_tokenizers.path(byte_bpe.RANK_FILE)).encode_ordinary(text or "")


def brute_ids(text):
    tokenizer = token_files._tokenizer(public_tokenizers.path(token_files.TOKENIZER_FILE))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_op5_matches_the_library(spark):
    got = {r.doc_id: r for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    rows = texts_of(SF)
    assert len(got) == len(rows)
    for i, text in rows:
        ids = brute_bpe(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_edge_rows(spark, make_docs, edge_rows):
    got = byte_bpe.bpe_decode(byte_bpe.bpe_encode(make_docs(edge_rows))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, tuple(brute_bpe(t)), (t or "").encode()) for i, t in edge_rows]
    assert sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)
    both = byte_bpe.bpe_decode(byte_bpe.bpe_encode(make_docs(edge_rows), decode=True), out_col="again").collect()
    assert len(both) == len(edge_rows) and all(r.decoded == r.again for r in both)
    assert byte_bpe.bpe_encode(make_docs([(1, "a")]).limit(0), decode=True).count() == 0


def test_bpe_small_batches_give_the_same(spark, make_docs, edge_rows, monkeypatch):
    rows = [(k, t) for k, (_, t) in enumerate(edge_rows)]
    explode = byte_bpe._explode

    def small(*a):
        run = explode(*a)

        def wrapped(batches):
            byte_bpe.BATCH_TOKENS = 50
            return run(batches)
        return wrapped

    monkeypatch.setattr(byte_bpe, "_explode", small)
    got = {r.doc_id: r.ids for r in byte_bpe.bpe_encode(make_docs(rows, 2)).collect()}
    assert got == {k: brute_bpe(t) for k, t in rows}


def test_pre_tokens_agree_with_the_library_on_every_character():
    find = regex.compile(public_tokenizers.PATTERN).findall
    encode = byte_bpe._encoding(public_tokenizers.path(byte_bpe.RANK_FILE)).encode_ordinary
    odd = []
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c) in ("Cn", "Cs", "Co", "Lo") and cp % 97:
            continue  # the big even blocks are sampled
        text = f"a{c}b {c}{c} 1{c}2 {c} x{c}"
        if [i for w in find(text) for i in encode(w)] != encode(text):
            odd.append(hex(cp))
    assert odd == []


def test_op6_matches_the_library(spark):
    got = {r.doc_id: r for r in QUERIES["op6_token_orc"](spark, SF).collect()}
    start = 0
    for i, text in texts_of(SF):
        ids = brute_ids(text)
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(texts_of(SF))


def test_token_files_edge_rows(spark, make_docs, edge_rows):
    path = scratch_path(spark, "t")
    token_files.write_tokens(make_docs(edge_rows), path)
    rows = token_files.token_starts(token_files.read_tokens(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in edge_rows), key=lambda i: (i is not None, i or 0))
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in rows), key=key) == sorted(((i, brute_ids(t)) for i, t in edge_rows), key=key)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    some = token_files.read_tokens(spark, path, ids=[8, 13])
    assert {r.doc_id: r.ids for r in some.collect()} == {i: brute_ids(t) for i, t in edge_rows if i in (8, 13)}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
    empty = scratch_path(spark, "t")
    token_files.write_tokens(make_docs([(1, "a")]).limit(0), empty)
    assert token_files.token_starts(token_files.read_tokens(spark, empty)).count() == 0


@pytest.mark.parametrize("cp", [0x09, 0x0B, 0x1C, 0x1F, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x301, 0x1161])
def test_chunks_agree_with_the_library(cp):
    text = f"a|b | || x| c{chr(cp)}| a{chr(cp)}b {chr(cp)} {chr(cp)}c d{chr(cp)} Σ{chr(cp)}Σ"
    table = token_files.ChunkIds(public_tokenizers.path(token_files.TOKENIZER_FILE))
    ids, n = table.of([text.encode(), None], 1)
    assert ids.tolist() == [*brute_ids(text), 1] and n.tolist() == [len(brute_ids(text)), 1]


def test_special_strings_as_the_library_reads_them(spark, make_docs):
    """Against the library with its defaults, built here."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "it'<|endoftext|>s", "<|ENDOFTEXT|> <|end oftext|>", " \t x\n\n", "e<|endoftext|>\u0301 \u0301"]
    path = scratch_path(spark, "t")
    token_files.write_tokens(make_docs(list(enumerate(texts))), path)
    got = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()}
    assert got == {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    assert got[0] == [320, 49407, 321, 1]
