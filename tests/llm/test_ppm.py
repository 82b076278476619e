import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumtrace.llm import ppm
from sumtrace.llm.common import fold

TEXTS = ["abracadabra", "abrakadabra alakazam", "", "é", "banana bandana", "the cat sat on the mat " * 4]


def trie_of(texts, order):
    trie = {}
    for text in texts:
        symbols = [ppm.END] * order + [*text.encode(), ppm.END]
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                follows = trie.setdefault(tuple(symbols[i - k : i]), {})
                follows[symbols[i]] = follows.get(symbols[i], 0) + 1
    return trie


def brute(context, symbol, trie):
    """Probability by the definition: escapes, with exclusion of what longer contexts have seen."""
    p, excluded = 1.0, set()
    for k in range(len(context), -1, -1):
        seen = {s: n for s, n in trie.get(tuple(context[len(context) - k :]), {}).items() if s not in excluded}
        if not seen:
            continue
        total = sum(seen.values()) + len(seen)
        if symbol in seen:
            return p * seen[symbol] / total
        p *= len(seen) / total
        excluded |= set(seen)
    return p / (ppm.SYMBOLS - len(excluded))


def arrays(texts, order):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    return ppm.runs(data, offsets, order)


def model(texts, order):
    codes, _ = arrays(texts, order)
    counts = []
    for k in range(order + 1):
        c, n = np.unique(codes & np.uint64((1 << 9 * (k + 1)) - 1), return_counts=True)
        counts.append((c, n))
    return ppm.model_of(counts)


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_probabilities_equal_the_definition_and_add_up(order):
    trie, m = trie_of(TEXTS, order), model(TEXTS, order)
    r = random.Random(order)
    for _ in range(25):
        context = [r.choice([*b"abn t", 200, ppm.END]) for _ in range(order)]
        base = sum(s << 9 * (order - i) for i, s in enumerate(context))
        codes = np.array([base | s for s in range(ppm.SYMBOLS)], np.uint64)
        p = 10 ** ppm.log_probabilities(codes, m)
        assert abs(p.sum() - 1) < 1e-4
        want = [brute(context, s, trie) for s in range(ppm.SYMBOLS)]
        assert np.allclose(p, want, rtol=1e-4)


def test_codes_begin_and_end_with_the_text():
    codes, begin = arrays(["ab", "", "c"], 2)
    e = ppm.END
    want = [(e, e, 97), (e, 97, 98), (97, 98, e), (e, e, e), (e, e, 99), (e, 99, e)]
    assert [(int(c) >> 18, int(c) >> 9 & 511, int(c) & 511) for c in codes] == want and begin.tolist() == [0, 3, 4, 6]


def test_table():
    keys = np.arange(0, 50000, 7, dtype=np.uint64) ** 2
    t = ppm.Table(keys, keys.astype(np.float32))
    at = t.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert (t.keys[at[: len(keys)]] == keys).all() and (at[len(keys) + 1 :] < 0).all()


def test_adaptive_length_equals_the_definition():
    text, order = "abracadabra é abracadabra", 3
    symbols = [ppm.END] * order + [*text.encode(), ppm.END]
    bits, trie = 0.0, {}
    for i in range(order, len(symbols)):
        bits -= math.log2(brute(symbols[i - order : i], symbols[i], trie))
        for k in range(order + 1):
            follows = trie.setdefault(tuple(symbols[i - k : i]), {})
            follows[symbols[i]] = follows.get(symbols[i], 0) + 1
    assert abs(ppm.adaptive_length(text, order) - bits) < 1e-9
    assert ppm.adaptive_length("ab" * 200) < ppm.adaptive_length("".join(random.Random(1).choices("abcdefgh", k=400)))


def test_scores(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = ppm.scored(odd_docs, fold("doc_id", 10) != 0, block_bytes=4000).collect()
    learn = [t or "" for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    trie = trie_of(learn, 4)
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    c = {}
    for t in learn:
        for w in tokens(t):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        symbols = [ppm.END] * 4 + [*(t or "").encode(), ppm.END]
        score = sum(math.log10(brute(symbols[k - 4 : k], symbols[k], trie)) for k in range(4, len(symbols))) if len(symbols) < 5000 else None
        want.append((i, len(own), sum(w in c for w in own), n, base, score))
    key = lambda r: (str(r[0]), r[1])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * abs(w[4])
        assert w[5] is None or abs(g[5] - w[5]) < 1e-4 * abs(w[5]) + 1e-4


def unpacked(counts, kind):
    rows = counts.where(F.col("kind") == kind).collect()
    return {r["bucket"]: (np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in rows}


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_parts_know_what_the_whole_model_knows(spark, order):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    counts, whole = ppm.counted(docs, order, 2, 3), model(TEXTS, order)
    short, packed = ppm.shortest(counts, order), unpacked(counts, ppm.RUNS)
    assert all(len(c) <= ppm.SYMBOLS ** (k + 1) for k, (c, _) in enumerate(short)) and len(short) == min(order + 1, ppm.SUFFIX)
    asked = np.unique(np.concatenate([arrays(TEXTS + ["never seen: zq\u4e2d", "abra"], order)[0]]))
    for part in range(3):
        own = [v for k, v in packed.items() if k // ppm.SPLIT == part]
        codes, n = ppm._summed([np.zeros(0, np.uint64), *(k for k, _ in own)], [np.zeros(0, np.int64), *(n for _, n in own)])
        mine = asked[ppm._part(asked, 3) == part]
        m = ppm.part_model(short, codes, n, order)
        assert np.array_equal(ppm.log_probabilities(mine, m), ppm.log_probabilities(mine, whole))


def test_every_count_of_a_large_trie_counts(spark, monkeypatch):
    """More than 400 000 pairs of orders 3 and 4 each: scores equal those of one model of everything."""
    monkeypatch.setattr(ppm, "SHARE", 2)
    letters = np.array([chr(c) for c in [*range(0x41, 0x7B), *range(0x400, 0x460), *range(0x4E00, 0x5600)]])
    r = np.random.Generator(np.random.PCG64(7))
    texts = ["".join(r.choice(letters, 9000)) for _ in range(48)] + ["".join(r.choice(letters[:60], 300_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    counts = ppm.counted(docs, 4, 6, 6).cache()
    sizes = [len(np.unique(np.concatenate([ppm._ending(k, o) for k, _ in unpacked(counts, ppm.RUNS).values()]))) for o in range(5)]
    counts.unpersist()
    assert min(sizes[3:]) > 400_000
    got = {x["doc_id"]: x["score"] for x in ppm.scored(docs, F.lit(True), block_bytes=200_000).collect()}
    whole = model(texts, 4)
    for i, text in enumerate(texts):
        want = ppm.log_probabilities(arrays([text], 4)[0], whole).sum()
        assert abs(got[i] - want) < 1e-5 * abs(want)


def test_the_whole_corpus_decides_what_a_text_costs(spark):
    """Rare runs keep their weight however many others there are."""
    rare, r = "zyx wvu", random.Random(3)
    few = [(1, rare)]
    many = few + [(k, "".join(r.choices("abcdefgh ", k=400))) for k in range(2, 200)]
    scores = []
    for rows in (few, many):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        scores.append(next(x["score"] for x in ppm.scored(docs, F.lit(True)).collect() if x["doc_id"] == 1))
    trie = trie_of([t for _, t in many], 4)
    symbols = [ppm.END] * 4 + [*rare.encode(), ppm.END]
    want = sum(math.log10(brute(symbols[k - 4 : k], symbols[k], trie)) for k in range(4, len(symbols)))
    assert abs(scores[1] - want) < 1e-4 * abs(want) and scores[1] != scores[0]


def test_without_training_rows(odd_docs, no_docs):
    rows = ppm.scored(odd_docs, F.lit(False)).collect()
    assert len(rows) == 12 and {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}
    empty = next(r for r in rows if r["doc_id"] == 2)
    assert abs(empty["score"] + math.log10(ppm.SYMBOLS)) < 1e-6
    assert ppm.scored(no_docs, F.lit(True)).count() == 0
