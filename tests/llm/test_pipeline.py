"""Each stage of the pipeline against brute force on what the stage before has kept."""

import hashlib
import os
from urllib.parse import urlparse

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from sumtrace.llm import bpe
from sumtrace.session import _cut_folder
from tests.conftest import SMALL
from tests.llm import test_decontaminate, test_simhash, test_substrings


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Documents before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in P.STAGES:
        stage(spark, frames[-1], SMALL).write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
    return [df.collect() for df in frames]


def test_stages(kept):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_passages", "test_items", "token_ids"]
    assert all(rows[0].asDict().keys() == kept[0][0].asDict().keys() for rows in kept[:-1])


def test_language_keeps_clean_documents(kept):
    before, after = kept[0], kept[1]
    assert set(after) <= set(before) and len(after) >= 0.99 * len(before)


def test_one_of_each_group(kept):
    before, after = sorted(kept[1], key=lambda r: r["doc_id"]), kept[2]
    prints = [test_simhash.brute_fingerprint(r["text"]) for r in before]
    first = test_simhash.brute_components(prints, 4)
    assert sorted(after) == sorted(before[i] for i in set(first))


def test_passages(kept):
    want = {i: (gone, text) for i, _, gone, text in test_substrings.brute([(r["doc_id"], r["text"]) for r in kept[2]])}
    after = {r["doc_id"]: r for r in kept[3]}
    assert len(after) == len(kept[3]) == len(kept[2])
    for r in kept[2]:
        gone, text = want[r["doc_id"]]
        own = after[r["doc_id"]]
        assert own["text"] == (text if gone else r["text"])
        assert own["n_chars"] == (len(text) if gone else r["n_chars"]) and own["lang"] == r["lang"]


def test_items(spark, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in kept[3]], items)}
    assert bad and sorted(kept[4]) == sorted(r for r in kept[3] if r["doc_id"] not in bad)


def test_ids(kept):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r["doc_id"]: r for r in kept[5]}
    assert len(got) == len(kept[4])
    for r in kept[4]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_run_equals_the_stages(spark, kept):
    out = P.run(spark, SMALL)
    assert sorted(out.collect()) == sorted(kept[5])


def test_only_the_last_stage_is_left(spark):
    folder = urlparse(_cut_folder(spark)).path
    before = set(os.listdir(folder))
    out = P.run(spark, SMALL)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop() in out.inputFiles()[0]


def test_columns_of_any_name_pass(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = docs.selectExpr("*", "77 AS _row", "'d' AS digest", "doc_id AS `digest_`", "1.5 AS root", "'x' AS `a.b`", "true AS gone")
    for stage in (P.one_of_each, P.without_test_items):
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and set(out.collect()) <= set(odd.collect()) and out.count() > 40


def test_equal_rows_of_one_group(spark, tmp_path):
    """A third of all rows equal, as many more equal but for their ids."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id + 10 END AS doc_id", f"CASE WHEN id % 3 < 2 THEN '{text}' ELSE concat('own', repeat(concat(' ', id), 30)) END AS text", "'en' AS lang", "'x' AS source", "1L AS n_chars")
    kept = sorted(r["doc_id"] for r in P.one_of_each(spark, docs.repartition(5), str(tmp_path)).collect())
    assert kept == [7] + [i + 10 for i in range(900) if i % 3 == 2]


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs, tmp_path):
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, stage in P.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
            assert name == "token_ids" or docs.columns == columns
    groups = P.one_of_each(spark, odd_docs, str(tmp_path))
    ids = [r["doc_id"] for r in groups.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 8, 9] and ids.count(None) == 2


def test_rows_of_one_id_or_none_are_judged_each(spark, tmp_path):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, e), (None, e), (None, f"x y z {c}")]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], schema)
    groups = P.one_of_each(spark, docs, str(tmp_path))
    kept = sorted(((r["doc_id"], r["text"]) for r in groups.collect()), key=str)
    one = sorted([(1, a), (2, b), (3, c), (3, d), (None, e), (None, f"x y z {c}")], key=str)
    assert kept == one
    spark.createDataFrame([(7, c)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = P.without_test_items(spark, docs, str(tmp_path))
    left = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str)
    assert left == sorted([(i, t) for i, t in rows if c not in t], key=str)
