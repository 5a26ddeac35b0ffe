"""Operators 1 and 2 against plain brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import xxhash
import zstandard

from prepark.llm import quality, simhash
from prepark.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, max_bits=2):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= max_bits:
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return sorted([(i, f"{f:016x}", low.get(root(k))) for k, (i, f) in enumerate(prints)], key=str)


def groups(df):
    return sorted([tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()], key=str)


def test_op1_matches_brute_force(spark):
    assert groups(QUERIES["op1_simhash"](spark, SF)) == brute_groups(texts_of(SF))


def test_op1_edge_rows(spark, make_docs, edge_rows):
    assert groups(simhash.simhash_groups(make_docs(edge_rows))) == brute_groups(edge_rows)
    assert simhash.simhash_groups(make_docs([(1, "a")]).limit(0)).count() == 0


def test_gray_search_finds_every_pair():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 60, 2)).astype(np.uint64)
    codes = np.unique(np.concatenate(((centres[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel(), centres)))
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    codes = codes[np.argsort(rank)]
    for bits in (0, 2, 4):
        i, j = simhash.gray_links(codes, codes, bits)
        a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(a.tolist(), b.tolist()))


def test_large_buckets_are_split_and_whole(spark):
    """One bucket with far more fingerprints than a node holds, links across its nodes."""
    rng = np.random.default_rng(7)
    low = rng.choice(1 << 42, 3000, replace=False).astype(np.int64)
    codes = np.unique(np.concatenate((low, low[:900] ^ (1 << 41), low[:900] ^ (1 << 13))))
    df = spark.createDataFrame([(int(c),) for c in codes], "fp long").repartition(4)
    from prepark.llm.common import connected_components
    got = {r.node: r.label for r in connected_components(simhash.link_edges(df)).collect()}
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    label = simhash._star(len(codes), a, b)
    for size in Counter(label.tolist()).values():
        assert size < 3000
    assert len(got) == sum(n for n in Counter(label.tolist()).values() if n > 1)
    classes = {}
    for c, x in zip(codes.tolist(), label.tolist()):
        if c in got:
            classes.setdefault(x, set()).add(got[c])
    assert all(len(v) == 1 for v in classes.values())
    assert len(classes) == len({*got.values()})


def brute_report(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if count[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines)) if len(lines) < 2000 else None
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_op2_matches_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op2_quality_bands"](spark, SF).collect()}
    rows = texts_of(SF)
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_report(text)
        assert not (r.kept and r.base_failed)


def test_quality_edge_rows(spark, make_docs, edge_rows):
    got = sorted(quality.quality_report(make_docs(edge_rows)).collect(), key=lambda r: str(r))
    want = sorted([(i, *brute_report(t)) for i, t in edge_rows], key=str)
    assert sorted([tuple(r)[:7] for r in got], key=str) == want
    docs = make_docs(edge_rows)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_bands_reject_repetitive_and_incompressible_text():
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rng = np.random.default_rng(1)
    noise = bytes(rng.integers(33, 127, 6000, np.uint8))
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary, 2000)).encode()
    assert quality.compression(prose, compress)[3]
    assert not quality.compression(noise, compress)[3]
    assert not quality.compression(b"buy now " * 100, compress)[3]
    assert not quality.compression(prose[:6000] + b"buy now " * 800, compress)[3]  # found by its chunks
    assert quality.compression(b"short", compress)[3]  # no band below 128 bytes


def test_the_rest_after_the_whole_chunks_is_judged():
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rng = np.random.default_rng(3)
    noise = bytes(rng.integers(33, 127, 2047, np.uint8))
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary, 2000)).encode()
    for tail in (noise, (b"buy now " * 300)[:2047]):
        assert quality.compression(prose[:2048] + tail, compress)[1:3] == (2, 1)
        assert not quality.compression(prose[:2048] + tail, compress)[3]
        assert quality.compression(prose[:6144] + tail, compress)[1:3] == (4, 1)
    assert quality.compression(prose[:4096], compress)[1:] == (2, 0, True)
    assert quality.compression(prose[:4097], compress)[1:] == (3, 0, True)
    assert quality.compression(prose[:2047], compress)[1:] == (0, 0, True)


def test_gray_tree_prunes_the_fingerprints_of_a_bucket(spark):
    """The codes compared one by one are a small share of all pairs, in a bucket of the
    size the search works on, on the fingerprints of the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [int(r.fingerprint, 16) for r in simhash.simhash_groups(docs).select("fingerprint").distinct().collect()]
    rng = np.random.default_rng(3)
    codes = np.unique(np.concatenate((np.array(rows, np.uint64), rng.integers(0, 1 << 63, 4000, np.uint64))))
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    codes = codes[np.argsort(rank)]
    i, j, compared = simhash.gray_search(codes, codes, 2, later=True)
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2, 1))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(a.tolist(), b.tolist()))
    assert compared < 0.2 * len(codes) * (len(codes) - 1) / 2


def test_bucket_longer_than_a_search_is_met_group_against_group(spark):
    """Cut buckets of tens of thousands: every planted link between nodes is found."""
    rng = np.random.default_rng(11)
    base = rng.choice(1 << 62, 40000, replace=False).astype(np.int64)
    planted = [(int(c), int(c) ^ (1 << int(x)) ^ (1 << int(y))) for c, x, y in
               zip(base[:300], rng.integers(0, 62, 300), rng.integers(0, 62, 300)) if x != y]
    codes = np.unique(np.concatenate((base, np.array([b for _, b in planted]))))
    from unittest import mock
    from prepark.llm.common import connected_components
    with mock.patch.object(simhash, "BUCKET", 1 << 20):  # one bucket
        got = {r.node: r.label for r in connected_components(
            simhash.link_edges(spark.createDataFrame([(int(c),) for c in codes], "fp long"))).collect()}
    assert all(got[a] == got[b] for a, b in planted)
