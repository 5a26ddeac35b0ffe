"""Operator 3 against brute force over all pairs of lines."""

import re

import numpy as np
import pytest

from harness import compare, duck
from prepark.llm import lines
from prepark.llm.catalog import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    return a == b or (abs(len(a) - len(b)) <= 1 and max(len(a), len(b)) >= 5 and distance(a, b) <= 1)


def brute(rows):
    every = [((i is None, i or 0, p), WORD.findall(x)) for i, t in rows if t is not None for p, x in enumerate(t.split("\n"))]
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        kept = []
        for p, x in enumerate(t.split("\n")):
            w, at = WORD.findall(x), (i is None, i or 0, p)
            if not w or not any(o < at and near(v, w) for o, v in every if v):
                kept.append(x)
        n = t.count("\n") + 1
        out.append((i, n, n - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_lines, r.n_removed, r.kept) for r in df.collect()], key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op3_matches_sql(spark, sf):
    ok, msg = compare(QUERIES["op3_line_dedup"](spark, sf).toPandas(), duck(sf).execute(ORACLE["op3_line_dedup"]).df())
    assert ok, msg


def test_edge_rows(spark, make_docs, edge_rows):
    rows = [r for r in edge_rows if r[0] not in (12, 13)]
    assert result(lines.line_dedup(make_docs(rows))) == brute(rows)
    assert result(lines.line_dedup(make_docs(edge_rows)))  # the very long lines too
    assert lines.line_dedup(make_docs([(1, "a")]).limit(0)).count() == 0


def test_edited_lines(spark, make_docs):
    rng = np.random.default_rng(2)
    words = list("abcdefgh")
    bases = [list(rng.choice(words, rng.integers(2, 9))) for _ in range(12)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.integers(0, 5)):
            w = list(bases[rng.integers(0, 12)])
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(0, len(w)))
                kind = rng.integers(0, 3)
                w[at:at + (kind != 0)] = [str(rng.choice(words))] if kind != 1 or len(w) == 1 else []
            text.append("  ".join(w) + " " * int(rng.integers(0, 2)))
        rows.append((int(rng.integers(0, 50)) if k % 9 else None, "\n".join(text)))
    rows = list(dict(((i, t), (i, t)) for i, t in rows).values())
    assert result(lines.line_dedup(make_docs(rows))) == brute(rows)


def test_one_template_with_many_values_links_to_its_first_line(spark, make_docs):
    rows = [(k, f"user {k} has logged in from home") for k in range(400)]
    got = result(lines.line_dedup(make_docs(rows)))
    assert sum(r[2] for r in got) == 399 and [r for r in got if r[2] == 0][0][0] == 0


def test_main_path_is_native_and_stage_keeps_columns(spark, make_docs):
    docs = make_docs([(1, "a line that stays here\nx"), (2, "a line that stays here\nother"), (3, "a line that stays there"),
                      (4, None), (5, "")])
    got = lines.drop_duplicate_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a line that stays here\nx", 2: "other", 4: None, 5: ""}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_only_lines_that_share_a_half_are_cut_and_only_where_the_edit_may_be(spark, make_docs, monkeypatch):
    """Full bitmaps let every line pass; the variants must not grow with what they let pass."""
    written, write = {}, lines.write_scratch
    monkeypatch.setattr(lines, "BITS", 64)
    monkeypatch.setattr(lines, "write_scratch", lambda df, name: written.setdefault(name, write(df, name)))
    alone = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(60)]
    same = [f"s{k}" for k in range(10)]
    even = [(100, " ".join(same)), (101, " ".join(same[:9] + ["t"])), (102, " ".join(same[:8] + same[9:]))]
    rows = alone + even
    assert result(lines.line_dedup(make_docs(rows))) == brute(rows)
    assert written["lines-near"].count() > 20  # lines of one kind alone passed
    # per line at most its whole, and two variants of each word behind the shared first half
    assert written["lines-variants"].count() <= 3 + 2 * (6 + 6 + 5)


def test_one_edit_at_every_place(spark, make_docs):
    """Each edit of lines of 4 to 12 words, each in documents of its own."""
    rows, at = [], 0
    for n in range(4, 13):
        for k in range(n):
            base = [f"n{n}k{k}w{j}" for j in range(n)]
            for line in (base[:k] + ["other"] + base[k + 1:], base[:k] + base[k + 1:], base[:k] + ["more"] + base[k:]):
                rows += [(at, " ".join(base)), (at + 1, " ".join(line))]
                at += 2
    for pick in (rows, [(len(rows) - i, t) for i, t in rows]):
        assert result(lines.line_dedup(make_docs(pick))) == brute(pick)
