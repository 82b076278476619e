import random
import re

import pytest

from sumtrace.llm import substrings as S
from tests.llm.conftest import WORDS


def brute(rows, n=13):
    """(n_words, n_removed, kept) of each row, from all windows of all rows."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("period,cover", [(7, (0, 1, 3)), (13, (0, 1, 3, 9)), (3, (0, 1)), (1, (0,))])
def test_all_shared_passages(spark, period, cover):
    r = random.Random(period)
    passages = [r.choices(WORDS, k=r.choice([12, 13, 14, 20, 60])) for _ in range(12)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(r.randint(0, 6)):
            words += r.choices(WORDS, k=r.randint(0, 15)) + (r.choice(passages) if r.random() < 0.6 else [])
        rows.append((r.randint(0, 70), " ".join(words)))
    rows.append((3, "same " * 100))
    rows.append((9, "same " * 50))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(x[2] for x in want) > 500
    assert result(S.without_repeats(docs, period=period, cover=cover, block_bytes=1500)) == want


def test_cover_must_cover():
    for period, cover, n in ((7, (0, 1), 13), (7, (0, 1, 2), 13), (7, (0, 1, 3), 6)):
        with pytest.raises(ValueError):
            S.checked_cover(period, cover, n)


def test_full_filter_only_costs_work(spark, monkeypatch):
    rows = [(i, " ".join(WORDS[i : i + 40])) for i in range(0, 120, 9)]
    full = S.shared_anchors
    monkeypatch.setattr(S, "shared_anchors", lambda *a: full(*a) | 255)
    assert result(S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(S.without_repeats(odd_docs)) == brute(rows)
    assert S.without_repeats(no_docs).count() == 0


def test_cleaned_keeps_rows_columns_and_untouched_texts(odd_docs):
    out = S.cleaned(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd_docs.count()
    assert rows[3]["text"] == " \n\t " and rows[1]["text"] is None
    assert rows[6]["text"] == "" and rows[6]["n_chars"] == 0 and rows[5]["n_chars"] == 1
