import random

import pytest
import xxhash

from sumtrace.llm import simhash
from sumtrace.llm.components import least_member


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    """Least position reachable, by flooding."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("text", [None, "", "a", "A b C", "a b c d", "Ab  c\nd\te\x0bf\x0cg", "é À ß 你 x " * 9, "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(str(i * i) for i in range(3000))
    monkeypatch.setattr(simhash, "_ROWS", 100)
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("distance,parts", [(4, 3), (4, 4), (3, 4), (2, 2), (6, 4), (0, 3)])
def test_radii_cover_every_split(distance, parts):
    r = simhash.radii(distance, parts)
    assert sum(x + 1 for x in r) > distance  # else one more error per segment would go unseen


def test_ball():
    assert sorted(simhash.ball(5, 1)) == [0, 1, 2, 4, 8, 16]
    assert len(simhash.ball(64, 2)) == 1 + 64 + 64 * 63 // 2


def near_values(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 6)]
    out = set()
    while len(out) < n:
        v = r.choice(base)
        for _ in range(r.randint(0, 5)):
            v ^= 1 << r.randrange(64)
        out.add(v)
    return sorted(v - (1 << 64) if v >> 63 else v for v in out)


@pytest.mark.parametrize("widths,crowd", [((23, 23, 18), 2048), ((23, 23, 18), 2), ((16, 16, 16, 16), 2048), ((32, 32), 2048)])
def test_links_connect_what_is_near(spark, widths, crowd):
    values = near_values(60, 5)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    pairs = simhash.links(fps, 4, widths, crowd).collect()
    assert all(p["a"] != p["b"] and bin((p["a"] ^ p["b"]) % (1 << 64)).count("1") <= 4 for p in pairs)
    root = {r["fp"]: r["root"] for r in least_member(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components([v % (1 << 64) for v in values], 4)
    assert [root.get(v, v) for v in values] == [values[i] for i in want]


def test_every_pair_where_nothing_is_crowded(spark):
    values = near_values(50, 8)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 4}
    assert got == want


def test_chain_is_one_component(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = {r["fp"]: r["root"] for r in least_member(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_edges(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[6]["component_id"] == 5 and {r["component_id"] for r in rows if r["doc_id"] is None} == {1, 5}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_whole_table(spark):
    from sumtrace.llm.queries import op1_simhash
    from tests.conftest import SMALL

    got = {r["doc_id"]: r for r in op1_simhash(spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(texts)
    want = [brute_fingerprint(texts[i]) for i in ids]
    assert [got[i]["fingerprint"] for i in ids] == [f"{v:016x}" for v in want]
    assert [got[i]["component_id"] for i in ids] == [ids[i] for i in brute_components(want, 4)]
