"""Fertility rules and the license scan against brute force."""

import collections
import re

import numpy as np
import pytest

from sumtrace.llm import fertility, licenses
from tests.conftest import SMALL
from tests.llm.conftest import WORDS


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times, covered = collections.Counter(runs), [False] * len(words)
    for k, run in enumerate(runs):
        if times[run] > 1:
            covered[k : k + 8] = [True] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeated = len(words), sum(covered)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n)


def test_base_on_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in fertility.judged(docs).collect()}
    for r in docs.collect():
        own = got[r["doc_id"]]
        assert tuple(own[1:7]) == brute_base(r["text"])
        assert not (own["kept"] and own["base_failed"])


def test_measures_equal_whole_encoding():
    files = fertility.default_vocabularies()
    byte_level, pieces, is_byte, _ = fertility._encoders(files)
    text = "Some words, ein Straßenname & 你好 repeated words, repeated words."
    data = np.frombuffer(text.encode(), np.uint8)
    got = fertility.measured_piece(data, np.array([0, len(data)]), files)
    words = text.split()
    ids = [i for w in words for i in byte_level.encode_ordinary(" " + w)]
    p = np.array(list(collections.Counter(ids).values())) / len(ids)
    own = [i for w in words for i in pieces.encode(w)]
    assert np.isclose(got["chars_per_token"][0], sum(map(len, words)) / len(ids))
    assert np.isclose(got["token_entropy"][0], -(p * np.log2(p)).sum() / np.log2(len(ids)))
    assert np.isclose(got["fallback_share"][0], is_byte[own].mean())


def test_other_kinds_of_text_are_rejected(spark):
    r = np.random.Generator(np.random.PCG64(2))
    plain = "the quick brown fox jumps over a lazy dog while seven wizards make toxic brew for an evil queen and her jacks".split()
    rows = [(i, " ".join(r.choice(plain, 60)), "en") for i in range(300)]
    rows.append((900, " ".join("".join(chr(c) for c in r.integers(0x10A0, 0x10FF, 7)) for _ in range(60)), "en"))
    rows.append((901, " ".join("".join(r.choice(list("xqzjkvw#$%"), 9)) for _ in range(60)), "en"))
    got = {x["doc_id"]: x for x in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[900]["kept"] and not got[901]["kept"] and not got[900]["base_failed"]
    assert all(got[i]["kept"] for i in range(300) if not got[i]["base_failed"])


def test_bands_reject_labelled_junk_and_keep_the_good(spark):
    folder = "/root/testdata/sf0.01"
    got = fertility.judged(spark.read.parquet(f"{folder}/documents.parquet")).where("NOT base_failed")
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    junk, good = ([r["kept"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(junk) >= 20 and len(good) >= 200
    assert junk.count(False) >= 0.4 * len(junk) and good.count(False) <= 0.02 * len(good)


def test_bounded_memory_gives_the_same(monkeypatch):
    files = fertility.default_vocabularies()
    data = np.frombuffer(" ".join(WORDS).encode(), np.uint8)
    ends = np.array([0, len(data) // 2, len(data)])
    want = fertility.measured_piece(data, ends, files)
    monkeypatch.setattr(fertility, "REMEMBERED", 3)
    got = fertility.measured_piece(data, ends, files)
    assert all((want[k] == got[k]).all() for k in want)


def test_rule_edges(odd_docs, no_docs):
    rows = fertility.judged(odd_docs).collect()
    assert len(rows) == 12
    blank = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] and r["chars_per_token"] is None for r in blank)
    for r in rows:
        if r["doc_id"] not in (None, 6, 7):
            text = odd_docs.where(f"doc_id = {r['doc_id']}").first()["text"]
            assert tuple(r[1:7]) == brute_base(text)
    assert fertility.judged(no_docs).count() == 0


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def grams(words, n=5):
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def brute_licenses(rows, templates, threshold=0.8):
    out = {}
    for i, text in rows:
        words = words_of(text)
        every = grams(words)
        for name, template in templates.items():
            want = set(grams(words_of(template)))
            if not want:
                continue
            step, length = licenses.window_shape((len(want) - 1).bit_length())
            for first in range(0, len(every), step):
                n = len(want & set(every[first : first + length]))
                if n >= threshold * len(want):
                    best = out.get((i, name), (0, 0))
                    out[i, name] = max(best, (n, -first))
    return {k: (n, -before) for k, (n, before) in out.items()}


def test_bands_are_enough():
    j = licenses.least_similarity(0.8)
    assert abs(j - 0.25) < 1e-9
    for rows in (1, 2, 3):
        b = licenses.bands_needed(j, rows, 1e-4)
        assert (1 - j**rows) ** b <= 1e-4 < (1 - j**rows) ** (b - 1)


def test_licenses_in_texts(spark):
    r = np.random.Generator(np.random.PCG64(3))
    rows, names = [], sorted(licenses.TEMPLATES)
    for i in range(60):
        words = list(r.choice(WORDS, r.integers(0, 300)))
        template = licenses.TEMPLATES[names[i % len(names)]].split()
        if i % 3 == 0 and len(template) > 20:
            template[int(r.integers(len(template)))] = "changed"
        at = int(r.integers(0, len(words) + 1))
        rows.append((i, "\n".join(words[:at]) + " " + " ".join(template).upper() + " " + " ".join(words[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["license"]): (x["n_found"], x["first_word"]) for x in licenses.licensed(docs).collect()}
    want = brute_licenses(rows, licenses.TEMPLATES)
    assert len(want) >= 60 and got == want


def test_scan_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = licenses.licensed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("templates", [{}, {"none": " .,;"}])
def test_no_template(odd_docs, templates):
    assert licenses.licensed(odd_docs, templates).count() == 0


def test_license_edges(odd_docs, no_docs):
    templates = {"forty": " ".join(WORDS[:40]), "short": "One, two; three!", "é": "Über Straße"}
    rows = sorted(((r["doc_id"], r["license"]) for r in licenses.licensed(odd_docs, templates).collect()), key=str)
    assert rows == sorted([(4, "short"), (5, "forty"), (6, "forty"), (7, "forty"), (None, "forty")], key=str)
    assert licenses.licensed(no_docs, templates).count() == 0


def test_too_many_templates(odd_docs, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_SHINGLES", 3)
    with pytest.raises(ValueError):
        licenses.licensed(odd_docs)
