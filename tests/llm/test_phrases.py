"""Phrase counts and scores against plain counting, whatever the memory budget."""

import re
from collections import Counter

import pytest

from sumtrace.llm import phrases as P
from tests.conftest import SMALL


def brute(rows, least, most=P.MOST):
    """Expected rows from (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            own.update(tuple(words[i : i + d]) for d in range(1, 5) for i in range(len(words) - d + 1))
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in own.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                left.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(left)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000")
    return docs, [(r["lang"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize(("budget", "block_bytes"), [(1 << 20, 1 << 22), (300, 20_000), (20, 50_000), (7, 1 << 22)])
def test_any_budget_gives_the_same_counts(spark, sample, budget, block_bytes):
    """Small budgets extend prefixes to two, three and four words."""
    docs, rows = sample
    want = brute(rows, 4)
    assert len(want) > 200
    assert got(P.collocations(docs, 4, budget=budget, block_bytes=block_bytes)) == want


def test_long_prefixes_and_a_passage_in_most_rows(spark):
    """One passage a thousand times: all prefixes of one to three words have too many suffixes."""
    same = "to be or not to be, that is the question to be or not"
    rows = [("en", same)] * 1000 + [("en", f"to be or w{i % 40} to be or not w{i % 7}") for i in range(500)] + [(None, "a b a b a b")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    for budget in (50, 1 << 20):
        assert got(P.collocations(docs, 9, budget=budget, block_bytes=3000)) == brute(rows, 9)


def test_most_is_per_language(spark, sample):
    docs, rows = sample
    assert got(P.collocations(docs, 6, most=25)) == brute(rows, 6, 25)


def test_tokens():
    words, index, begins = P.tokens("A b,a\tB\x0bÄ a b.\n".encode())
    assert [words[i].as_py().decode() for i in index] == ["a", "b", "a", "b", "Ä", "a b"]
    assert begins.tolist() == [True, False, True, False, True, False]
    assert not len(P.tokens(b" .,")[1]) and not len(P.tokens(b"")[1])


def test_segments_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i}" + "." * (i % 5 == 0) for i in range(300)).encode()
    whole = P.tokens(text)
    monkeypatch.setattr(P, "_SEGMENT", 50)
    parts = P.tokens(text)
    assert parts[0].equals(whole[0]) and (parts[1] == whole[1]).all() and (parts[2] == whole[2]).all()


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(8 * 10**17, 9 * 10**17, 8 * 10**17)], "a long, l long, r long")
    assert df.select(P._score()).first()[0] == 2_000_000 * 8 * 10**17 // (17 * 10**17)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert got(P.collocations(odd_docs, 2, most=10**6)) == brute(rows, 2, 10**6)
    assert got(P.collocations(no_docs)) == []
