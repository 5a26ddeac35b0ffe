"""Operators 8 and 9: held-out quality, fixed cases, edge rows."""

import zlib

import duckdb
import numpy as np

from prepark.llm import language, toxicity
from prepark.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_op9_held_out_accuracy(spark):
    got = QUERIES["op9_language_viterbi"](spark, SF).toPandas()
    truth = duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").df()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) == len(both)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out & both.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert both.score.between(0, 1).all() and set(both.lang_pred) <= {*truth.lang.dropna(), "und"}


SPOKEN = [("en", "the weather was nice and they walked through the old town with their friends"),
          ("de", "das wetter war schön und sie gingen mit ihren freunden durch die alte stadt"),
          ("ru", "погода была хорошая и они гуляли с друзьями по старому городу"),
          ("el", "ο καιρός ήταν καλός και περπατούσαν με τους φίλους τους στην παλιά πόλη")]


def brute_viterbi(scores, switch):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = int(np.argmax(best))
        came = [top if best[top] - switch > best[k] else k for k in range(len(row))]
        best = [(best[top] - switch if came[k] != k else best[k]) + row[k] for k in range(len(row))]
        back.append(came)
    path = [int(np.argmax(best))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_scripts_spans_and_viterbi(spark, make_docs):
    schema = "doc_id long, lang string, text string"
    model = language.learn(spark.createDataFrame([(k, a, t * 3) for k, (a, t) in enumerate(SPOKEN)] + [(9, None, "x"), (10, "en", None)], schema))
    assert model[0] == ["de", "el", "en", "ru"]
    en, de, ru, el = (t for _, t in SPOKEN)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, en), (5, f"{de}. {de}"), (6, ru), (7, f"{en} {en} {ru}"), (8, "☃ 東京"), (None, el)]
    got = {r.doc_id: r for r in language.predict_language(make_docs(rows), model).collect()}
    assert {i: r.lang_pred for i, r in got.items()} | {8: ""} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "ru", 7: "en", 8: "", None: "el"}
    assert got[1].score == 0 and got[4].score == 1
    n = len(en.split())
    assert [tuple(s) for s in got[7].spans] == [(0, 2 * n, "en"), (2 * n, 2 * n + len(ru.split()), "ru")]
    m = language.Model(*model)
    rng = np.random.default_rng(1)
    every = [w for _, t in SPOKEN for w in language.letter_words(t)]
    texts = [[every[k] for k in rng.integers(0, len(every), n)] for n in (1, 5, 40, 200)]
    codes = m.codes(texts)
    for own, label in zip(codes, m.label(codes)):
        path = brute_viterbi(m.scores[own], language.SWITCH)
        cost = lambda p: m.scores[own, p].sum() - language.SWITCH * np.count_nonzero(np.diff(p))
        assert np.isclose(cost(np.array(path)), cost(label.astype(int)), atol=1e-2)


def test_language_edge_rows(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    nothing = language.learn(docs.limit(0).selectExpr("doc_id", "text", "label as lang"))
    assert {r.lang_pred for r in language.predict_language(docs, nothing).collect()} == {"und"}
    model = language.learn(spark.createDataFrame(SPOKEN, "lang string, text string"))
    assert language.predict_language(docs, model).count() == len(edge_rows)
    assert language.predict_language(docs.limit(0), model).count() == 0


def test_ngrams_do_not_cross_words():
    one, n = language.gram_buckets([b"abc", b"z", "ñandú".encode()])
    alone = [language.gram_buckets([w])[0].tolist() for w in (b"abc", b"z", "ñandú".encode())]
    assert one.tolist() == sum(alone, []) and n.tolist() == [len(a) for a in alone]


def test_op8_separates_held_out_labels(spark):
    """Learn from two thirds of the labelled rows, judge on the others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train_chain(docs, labels.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    held = labels.filter("crc32(cast(doc_id as string)) % 3 = 1").withColumnRenamed("toxic", "truth")
    got = toxicity.predict_chain(docs, chain).join(held, "doc_id").toPandas()
    toxic = got.truth == 1  # some junk texts keep the label of a toxic text and none of its words
    assert got.toxic[toxic & (got.quality == 1)].mean() > 0.9 and got.toxic[~toxic].mean() < 0.01
    assert got.p_quality[got.quality == 1].mean() > 0.9 > 0.3 > got.p_quality[got.quality == 0].mean()


def test_op8_returns_every_document(spark):
    got = QUERIES["op8_toxicity_chain"](spark, SF).toPandas()
    assert len(got) == 1000 and got.columns.tolist() == ["doc_id", "p_quality", "p_toxic", "toxic"]


def test_toxicity_edge_rows(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (13, 0, 1), (None, 1, 1), (9, None, 1), (99, 1, 1), (1, 1, 1)], schema)
    for some in (labels, labels.limit(0)):
        got = toxicity.predict_chain(docs, toxicity.train_chain(docs, some)).collect()
        assert len(got) == len(edge_rows)
        assert all(r.p_toxic is None and not r.toxic for r in got if r.doc_id in (1, 2, 3))
    assert not any(r.toxic for r in got)
    assert toxicity.predict_chain(docs.limit(0), ([np.zeros(toxicity.DIMS + 1), np.zeros(toxicity.DIMS + 2)], 0.5)).count() == 0


def test_a_chain_passes_earlier_predictions_on():
    rng = np.random.default_rng(3)
    first = rng.integers(0, 2, 600).astype(float)
    x = toxicity.Sparse(np.ones(600, np.int64), rng.integers(0, 50, 600))
    w, v = toxicity.fit(x, toxicity.logit(np.where(first > 0, 0.9, 0.1))[:, None], first)
    assert v[0] > 0.5  # the second target is told by the first one's probability
