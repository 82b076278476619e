import random

from sumtrace.llm import decontaminate as D
from tests.llm.conftest import WORDS


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, items, threshold=0.8):
    out = {}
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(want & have) >= threshold * len(want):
                out[d, i] = max(out.get((d, i), 0), len(want & have) / len(want))
    return out


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["containment"] for r in D.contained_items(d, i, **more).collect()}


def test_passages_in_long_documents(spark):
    r = random.Random(1)
    items = [(i, " ".join(r.choices(WORDS, k=r.choice([3, 5, 6, 9, 20, 40, 130])))) for i in range(40)]
    docs = []
    for d in range(60):
        words = r.choices(WORDS, k=r.choice([0, 4, 30, 800]))
        for _, item in r.sample(items, 2):
            own = item.split()
            if r.random() < 0.5 and len(own) > 12:  # a damaged copy
                own[r.randrange(len(own))] = "other"
            at = r.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, r.choice([" ", "\n", "  "]).join(words).upper()))
    want = brute(docs, items)
    assert len(want) > 60 and found(spark, docs, items) == want


def test_scattered_shingles_are_verified_over_the_whole_document(spark):
    item = WORDS[:30]
    text = " ".join(item[:18] + ["x"] * 300 + item[14:])
    assert found(spark, [(1, text)], [(7, " ".join(item))]) == {(1, 7): 1.0}


def test_small_filter_only_costs_work(spark):
    docs = [(1, " ".join(WORDS[:60])), (2, " ".join(WORDS[60:90]))]
    items = [(1, " ".join(WORDS[20:50])), (2, "no such words in any of them")]
    assert found(spark, docs, items, filter_bits=15) == {(1, 1): 1.0}


def test_edges(spark, odd_docs, no_docs):
    items = [(1, None), (2, ""), (3, "One  two\nTHREE"), (4, " ".join(WORDS[5:25])), (4, " ".join(WORDS[5:25])), (None, " ".join(WORDS[5:20])), (6, "one two")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'t' AS hits")
    got = sorted(((r["doc_id"], r["item_id"], r["containment"]) for r in D.contained_items(odd_docs, table).collect()), key=str)
    whole = [(d, i, 1.0) for d in (5, 6, 7, None) for i in (4, None)]
    assert got == sorted([(4, 3, 1.0), *whole], key=str)
    assert D.contained_items(no_docs, table).count() == 0
    assert D.contained_items(odd_docs, table.where("false")).count() == 0
