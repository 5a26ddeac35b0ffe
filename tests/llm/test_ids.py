"""Ids of another type, and copies that hold a third of all rows."""

import pytest

from prepark.llm import byte_bpe, lines, simhash, substrings, token_files, windows
from prepark.session import scratch_path

TEXT = " ".join(f"word{k} is here" for k in range(40))


@pytest.fixture(scope="module")
def named(spark):
    rows = [("b", TEXT), ("a", TEXT), (None, TEXT), ("c", None), ("d", "x " + TEXT)]
    return spark.createDataFrame(rows, "name string, body string")


def by_name(df, *cols):
    return {r["name"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_text_ids(spark, named):
    col = {"id_col": "name", "text_col": "body"}
    assert by_name(simhash.simhash_groups(named, **col), "component_id")["b"] == ("a",)
    assert by_name(lines.line_dedup(named, **col), "n_removed") == {"a": (0,), "b": (1,), None: (1,), "c": (0,), "d": (1,)}
    n = by_name(windows.window_dedup(named, **col), "n_removed")
    assert n == {"a": (0,), "b": (120,), None: (120,), "c": (0,), "d": (120,)}
    n = by_name(substrings.substring_dedup(named, **col), "n_removed")
    assert n == {"a": (0,), "b": (len(TEXT),), None: (len(TEXT),), "c": (0,), "d": (len(TEXT),)}
    assert by_name(byte_bpe.bpe_encode(named, **col), "ids")["c"] == ([],)
    path = scratch_path(spark, "t")
    token_files.write_tokens(named, path, **col)
    rows = token_files.token_starts(token_files.read_tokens(spark, path, "name")).orderBy("start").collect()
    assert [r["name"] for r in rows] == [None, "a", "b", "c", "d"]


def test_one_group_of_copies_holds_a_third(spark, make_docs):
    other = [(k, " ".join(f"t{k}x{j}" for j in range(60))) for k in range(200, 600)]
    docs = make_docs([(k, TEXT) for k in range(200)] + other, 7)
    got = simhash.simhash_groups(docs).collect()
    assert sum(r.component_id == 0 for r in got) == 200 and len({r.component_id for r in got}) == 401
    for cut, whole in ((windows.window_dedup(docs), 120), (substrings.substring_dedup(docs), len(TEXT)), (lines.line_dedup(docs), 1)):
        assert sorted(r.n_removed for r in cut.collect()) == [0] * 401 + [whole] * 199
