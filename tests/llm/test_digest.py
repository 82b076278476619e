"""Fingerprints against slow versions that follow the definitions window by window."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from sumtrace.llm import digest as D
from sumtrace.llm.queries import queries
from tests.conftest import SMALL


def brute_class(window):
    whole = round(D.WIDTH * math.log2(D.WIDTH) * 1024)
    total = sum(round(c * math.log2(c) * 1024) for c in Counter(window).values())
    return (whole - total) * (D.CLASSES - 1) // whole


def brute_windows(text):
    return [text[i : i + D.WIDTH] for i in range(len(text) - D.WIDTH + 1)]


def brute_ranks(texts):
    n = Counter(brute_class(w) for t in texts for w in brute_windows(t))
    order = sorted(range(D.CLASSES), key=lambda c: (n[c], c))
    return np.array([order.index(c) for c in range(D.CLASSES)], np.int64)


def brute_selected(text, ranks):
    """Places of the selected windows of one text."""
    keys = [(ranks[c], i) if (c := brute_class(w)) >= D.WEAK else None for i, w in enumerate(brute_windows(text))]
    points = Counter()
    for begin in range(1 - D.RUN, len(keys)):
        run = [k for k in keys[max(0, begin) : begin + D.RUN] if k is not None]
        if run:
            points[min(run)[1]] += 1
    return [i for i in sorted(points) if points[i] >= D.POINTS]


def brute_print(text, ranks):
    data = np.frombuffer(text, np.uint8)
    at = brute_selected(text, ranks)
    hashes = list(dict.fromkeys(D._hashed(data, np.array(at)).tolist() if at else D._text_hash(text).tolist() if text else []))
    out = ""
    for i in range(0, len(hashes), D.FEATURES):
        bits = set()
        for h in hashes[i : i + D.FEATURES]:
            bits |= {h >> 11 * k & 2047 for k in range(5)}
        cell = bytes(sum(128 >> j for j in range(8) if 8 * b + j in bits) for b in range(256))
        out += f"{len(hashes[i:i + D.FEATURES]):02x}{cell.hex()}"
    return out


def random_texts():
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"etaoin shrdlu\n", np.uint8)
    sizes = [0, 1, 5, 31, 32, 33, 63, 64, 65, 200, 3000]
    return [*(rng.choice(letters, n).tobytes() for n in sizes), b"a" * 100, b"ab" * 40, b"x" * 40 + bytes(range(40, 120))]


def test_classes_and_selection():
    texts = random_texts()
    ranks = brute_ranks(texts)
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        assert D.classes(data).tolist() == [brute_class(w) for w in brute_windows(t)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [o + i for t, o in zip(texts, offsets.tolist()) for i in brute_selected(t, ranks)]
    assert D.selected(data, offsets, ranks).tolist() == want
    assert [str(p) for p in D.prints(texts, ranks)] == [brute_print(t, ranks) for t in texts]


def test_pieces_make_no_difference(monkeypatch):
    texts = random_texts()
    ranks = brute_ranks(texts)
    whole = [str(p) for p in D.prints(texts, ranks)]
    for size in (40, 97, 1000):
        monkeypatch.setattr(D, "_PIECE", size)
        assert [str(p) for p in D.prints(texts, ranks)] == whole


def test_likeness():
    rng = np.random.default_rng(5)
    a, b = (rng.choice(np.arange(97, 123, dtype=np.uint8), 40_000).tobytes() for _ in "ab")
    ranks = np.arange(D.CLASSES)
    pa, pb, pe, mixed = D.prints([a, b, b"", a[:20_000] + b[:20_000]], ranks)
    assert D.likeness(pa, pa) == 1 and D.likeness(pe, pe) == 1 and D.likeness(pa, pe) == 0
    assert D.likeness(pa, pb) < 0.05
    assert 0.4 < D.likeness(pa, mixed) < 0.65 and D.likeness(pa, mixed) == D.likeness(mixed, pa)
    assert D.likeness(D.Print.parsed(str(pa)), pa) == 1 and len(pa.counts) > 3


def want_rows(rows, ranks):
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text)
        new = text[: n - n // 2] + after[: n // 2]
        own, changed, other = (D.Print.parsed(brute_print(t.encode(), ranks)) for t in (text, new, after))
        out.append((doc, n, hashlib.sha256(new.encode()).hexdigest(), str(own), str(changed), D.likeness(own, changed), D.likeness(own, other)))
    return out


def test_query_against_brute_force(spark):
    """Twenty rows of the table, chosen for the speed of the slow version, all of them compared."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("n_chars").limit(20).select("doc_id", "text")
    rows = sorted([(r[0], r[1] or "") for r in docs.collect()], reverse=True)
    ranks = brute_ranks([t.encode() for _, t in rows])
    assert D.rarity(docs).tolist() == ranks.tolist()
    got = D.fingerprinted(docs).select(*D._NAMES).collect()
    assert sorted(map(tuple, got)) == sorted(want_rows(rows, ranks))


def test_query_covers_the_table(spark):
    got = queries()["op13_fingerprints"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    both = got.merge(docs, on="doc_id")
    assert (both.n_chars_x == both.text.str.len()).all()
    for _, own in both.groupby("text"):
        assert own.fingerprint.nunique() == 1
    long = both[both.n_chars_x >= 400]
    assert (long.near_edited > long.near_next).mean() > 0.95 and long.near_edited.median() > 0.35
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_rows(spark, odd_docs, no_docs, partitions):
    got = D.fingerprinted(odd_docs.repartition(partitions)).collect()
    texts = sorted(odd_docs.select("doc_id", "text").collect(), key=str)
    assert sorted((r["doc_id"], r["n_chars"]) for r in got if r["doc_id"]) == sorted((i, len(t or "")) for i, t in texts if i)
    assert len(got) == len(texts) and sum(r["doc_id"] is None for r in got) == 2
    prints = {}
    for r in got:
        if r["doc_id"] is not None:
            prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[5] == prints[6] and prints[1] == prints[2] == {""} and len(prints[7]) == 1
    assert D.fingerprinted(no_docs).collect() == []
    one = D.fingerprinted(odd_docs.where("doc_id = 5")).collect()[0]
    assert one["near_next"] == 1


def test_equal_rows_lie_in_several_ranges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", f"if(id % 3 = 0, '{text}', concat('{text} ', id)) AS text")
    got = D.fingerprinted(docs).select("doc_id", "n_chars").collect()
    assert sorted(got) == sorted(docs.selectExpr("doc_id", "cast(length(text) AS long)").collect())
