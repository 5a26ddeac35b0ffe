"""Operator 7 against brute force over all alignments of documents with items."""

import duckdb

from prepark.llm import decontaminate as D
from prepark.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    got = [D.template_token(w.decode()) for w in (text or "").encode().split()]
    return [g for g in got if g[0]]


def brute(docs, items):
    """{(doc_id, item_id): tokens covered} by trying every alignment."""
    found = {}
    split = [(j, tokens(t)) for j, t in items]
    sizes = {min(D.WINDOW, len(item)) for _, item in split if len(item) >= D.LITERALS}
    for i, text in docs:
        doc = tokens(text)
        places = {}
        for size in sizes:
            for p in range(len(doc) - size + 1):
                places.setdefault(tuple(t for t, _ in doc[p:p + size]), []).append(p)
        for j, item in split:
            size = min(D.WINDOW, len(item))
            if size < D.LITERALS:
                continue
            starts, seen, reach = {}, set(), set()
            for q in range(len(item) - size + 1):
                own, template = item[q:q + size], tuple(t for t, _ in item[q:q + size])
                if sum(s is None for _, s in own) < min(D.LITERALS, size) or template in seen:
                    continue
                seen.add(template)
                reach.update(range(q, q + size))
                for p in places.get(template, []):
                    starts.setdefault(p - q, []).append(q)
            for shift, at in starts.items():
                covered = sorted({k for q in at for k in range(q, q + size)})
                pairs = {(item[k][1], doc[k + shift][1]) for k in covered if item[k][1] is not None}
                if len({a for a, _ in pairs}) == len(pairs) and len(covered) >= min(D.COVER, len(reach)):
                    found[i, j] = max(found.get((i, j), 0), len(covered))
    return found


def result(df):
    return {(r.doc_id, r.item_id): r.n_covered for r in df.collect()}


def test_op7_matches_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rows = QUERIES["op7_template_decontamination"](spark, SF).collect()
    got = {(r.doc_id, r.item_id): r.n_covered for r in rows}
    assert got == brute(docs, items) and len(got) == len(rows) > 0
    whole = {(i, j) for i, t in docs for j, b in items if b in t}
    assert whole <= set(got)


QUESTION = "Tom buys 3 red apples and 12 green pears at the market, and gives Tom's friend 3 kg of plums before lunch."


def test_reparameterised_questions_and_slot_consistency(spark, make_docs):
    filler = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [
        (1, f"{filler} {QUESTION} {filler}"),
        (2, f"{filler} {QUESTION.replace('Tom', 'Ann').replace('3', '7').replace('12', '40')}"),
        (3, QUESTION.replace("buys 3", "buys 5")),  # 3 stands for 5 here and for 3 there
        (4, QUESTION.replace("kg", "pounds").upper()), (5, filler), (6, None), (7, ""),
        (8, "Tom buys 3 red apples and 12 green"), (None, QUESTION), (9, QUESTION), (9, QUESTION)]
    items = spark.createDataFrame([(10, QUESTION), (11, "too short"), (12, None), (13, "all six words of this item")],
                                  "item_id long, text string")
    docs = make_docs([*rows, (14, "he read all six words of this item aloud")])
    got = {(r.doc_id, r.item_id): r.n_changed for r in D.contamination(docs, items).collect()}
    assert got == {(1, 10): 0, (2, 10): 4, (None, 10): 0, (9, 10): 0, (14, 13): 0}
    assert result(D.contamination(docs, items)) == brute([*rows, (14, "he read all six words of this item aloud")],
                                                         [(r.item_id, r.text) for r in items.collect()])
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8]
    assert D.contamination(docs.limit(0), items).count() == 0 and D.contamination(docs, items.limit(0)).count() == 0


def test_edge_rows(spark, make_docs, edge_rows):
    items = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(edge_rows)], "item_id long, text string")
    want = brute(dict.fromkeys(edge_rows), [(k, t) for k, (_, t) in enumerate(edge_rows)])
    assert result(D.contamination(make_docs(edge_rows), items)) == want


def test_words_by_kind():
    kinds = {w: D.template_token(w)[0] for w in ("3,5", "(Tom)", "kg.", "Three", "apples!", "--", "x2", "Émile")}
    assert kinds == {"3,5": "<num>", "(Tom)": "<name>", "kg.": "<unit>", "Three": "<num>", "apples!": "apples", "--": "",
                     "x2": "<num>", "Émile": "<name>"}


def test_all_rules_find_copies_in_any_case_and_dense_in_numbers(spark, make_docs):
    dense = "Compute 12 plus 7 times 3 minus 4 plus 18 times 2 minus 5 plus 9"
    renamed = QUESTION.replace("Tom", "Ann").replace("12", "40")
    rows = [(1, QUESTION.upper()), (2, QUESTION.title()), (3, QUESTION.lower()), (4, f"so {dense} ."), (5, dense.upper()),
            (6, renamed.upper()), (7, renamed.title()), (8, dense.replace("12", "13").replace("18", "19")),
            (9, QUESTION.upper().replace("BUYS 3", "BUYS 5").replace("PEARS", "FIGS").replace("FRIEND", "AUNT")), (10, QUESTION), (None, None)]
    items = spark.createDataFrame([(10, QUESTION), (11, dense)], "item_id long, text string")
    want = {(1, 10), (2, 10), (3, 10), (4, 11), (5, 11), (6, 10), (7, 10), (10, 10)}
    assert set(result(D.contamination(make_docs(rows), items, rules=D.RULES))) == want
    kept = D.drop_contaminated(make_docs(rows), items, rules=D.RULES)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [8, 9, None]


def test_slots_may_change_their_number_of_words(spark, make_docs):
    train = "A train leaves at 9 and travels 60 km in 2 hours before it stops for lunch"
    tale = "At dusk Tom carries old boxes and Tom paints them blue, then Tom sells most of them at dawn."
    rows = [(1, train.replace("60", "sixty five")), (2, train.replace("60", "75")), (3, tale.replace("Tom", "Mary Ann")),
            (4, tale.replace("Tom", "Mary Ann", 1).replace("Tom", "Zoe", 1)),  # one name stands for three
            (5, tale.replace("Tom", "MARY ANN").upper()), (6, train.replace("9", "one hundred twenty").title())]
    items = spark.createDataFrame([(10, train), (11, tale)], "item_id long, text string")
    want = {(1, 10), (2, 10), (3, 11), (5, 11), (6, 10)}
    assert set(result(D.contamination(make_docs(rows), items, rules=D.RULES))) == want
    got = {r.doc_id: r for r in D.contamination(make_docs(rows), items, rules=D.RULES).collect()}
    assert got[1].n_tokens == 17 and got[1].n_covered == 17 and (got[1].first_word, got[1].end_word) == (0, 18)
