"""Language, toxicity and page models: held-out accuracy and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sumtrace.llm import language, pages, toxicity
from sumtrace.llm.common import bounded_sample, fold
from tests.conftest import SMALL

TABLES = SMALL.replace("sf0.001", "sf0.01")


def test_fold_is_crc32_of_the_id_as_text(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", fold("doc_id", 5)).collect()}
    assert got == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i in got}


def test_sample_is_bounded_and_deterministic(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id < 30, 'rare', 'common') AS lang")
    rows = bounded_sample(df, "lang", 500)
    n = sum(r["lang"] == "common" for r in rows)
    assert sum(r["lang"] == "rare" for r in rows) == 30 and 400 < n < 600
    assert rows == bounded_sample(df.repartition(7), "lang", 500)


def test_language_on_rows_not_learnt_from(spark):
    from sumtrace.llm.queries import op6_language

    rows = op6_language(spark, TABLES).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(held) > 150
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(odd_docs, no_docs):
    model = language.trained(odd_docs, F.lit(True))
    rows = {r["doc_id"]: r for r in language.identified(odd_docs, model).collect()}
    assert model.languages == ["de", "en", "fr", "ru"]
    for i in (1, 2, 3):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and not rows[i]["accepted"]
    assert rows[8]["lang_pred"] in model.languages
    assert language.identified(no_docs, model).count() == 0
    nothing = language.trained(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in language.identified(odd_docs, nothing).collect()} == {"und"}
    digits = language.predict(pa.array(["12 34", "½", "_", "a1"]), model)[0]
    assert digits[:3] == ["und"] * 3 and digits[3] != "und"


def test_accepted_rows_are_unchanged(odd_docs):
    model = language.trained(odd_docs, F.lit(True))
    out = language.accepted(odd_docs, model)
    assert out.schema == odd_docs.schema
    assert {r["doc_id"] for r in out.collect()} <= {4, 5, 6, 7, 8, 9, None}


def test_subwords_stay_within_their_text():
    data = np.frombuffer("abcdab".encode(), np.uint8)
    apart = language.subwords(data, np.array([0, 4, 4, 6]))
    alone = [language.subwords(data[a:b], np.array([0, b - a])) for a, b in ((0, 4), (4, 6))]
    for i in range(len(apart)):
        assert (apart[i] == np.concatenate([alone[0][i], alone[1][i]])).all()


def toy(n, seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "kalomirentusa" for b in "xyzuv"]
    bad = ["grumblak", "zonkerdu", "zonkerei", "zonkerlo"]
    out = []
    for i in range(n):
        text = r.choices(words, k=r.randint(1, 80))
        toxic = i % 2
        if toxic:
            text[r.randrange(len(text))] = r.choice(bad)
        out.append((" ".join(text), toxic, r.choice(["aa", "bb", None])))
    return out


def test_toxicity_is_learnt():
    train, test = toy(800, 1), toy(200, 2)
    m = toxicity.fit([t for t, _, _ in train], [y for _, y, _ in train], [lg for *_, lg in train], 0.5)
    p = toxicity.score(pa.array([t for t, *_ in test]), m)
    y = np.array([y for _, y, _ in test])
    assert ((p >= 0.3) == y).mean() > 0.97
    assert set(m.thresholds) <= {None, "aa", "bb"}


def test_responses_at_ends_of_texts():
    r = np.random.Generator(np.random.PCG64(1))
    x, kernel = r.standard_normal((9, 12)).astype(np.float32), r.standard_normal((12, 48)).astype(np.float32)
    first, offset = np.array([0, 1, 1, 3, 9]), np.zeros(24, np.float32)
    got = toxicity.responses(x, first, kernel, offset)
    cube = kernel.reshape(12, 6, 8)
    for a, b in zip(first[:-1], first[1:]):
        for i in range(a, b):
            for f, (width, tap) in enumerate(((1, 0), (2, 1), (3, 3))):
                want = sum(x[i + k] @ cube[:, tap + k] for k in range(width) if i + k < b)
                assert np.allclose(got[i, f * 8 : f * 8 + 8], want, atol=1e-4)


def test_every_labelled_row_teaches(spark):
    """One sign of toxicity stands only in rows that a sample of 2 500 rows per label by their hash passes over."""
    rows = [(i, " ".join(w for w in text.split() if w[:3] not in ("gru", "zon")), y) for i, (text, y, _) in enumerate(toy(8000, 3))]
    drawn = F.pmod(F.xxhash64("doc_id", "toxic", F.lit(1)), F.lit(1 << 40)) / (1 << 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    docs = docs.withColumn("late", drawn > 0.9).cache()
    sign = F.when(F.col("late"), "zonkerdu").otherwise("grumblak")
    texts = docs.select("doc_id", F.when(F.col("toxic") == 1, F.concat_ws(" ", sign, "text")).otherwise(F.col("text")).alias("text"), F.lit("aa").alias("lang"))
    m = toxicity.trained(texts, docs.select("doc_id", F.col("toxic")), F.lit(True))
    fresh = [" ".join(w for w in text.split() if w[:3] not in ("gru", "zon")) for text, *_ in toy(200, 4)]
    p, clean = toxicity.score(pa.array(["zonkerdu " + t for t in fresh]), m), toxicity.score(pa.array(fresh), m)
    assert (p >= 0.3).mean() > 0.95 and (clean < 0.3).mean() > 0.95


def test_parts_learn_together(spark):
    """Each sign of toxicity is known to parts of the rows only; the common model knows them all, whatever the partitions."""
    rows = [(i, text, lang, y) for i, (text, y, lang) in enumerate(toy(1200, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    scores = []
    for n in (2, 5):
        m = toxicity.trained(docs.repartition(n), docs.select("doc_id", "toxic"), F.lit(True), part_rows=250)
        test = toy(200, 6)
        scores.append(toxicity.score(pa.array([t for t, *_ in test]), m))
        assert ((scores[-1] >= 0.3) == np.array([y for _, y, _ in test])).mean() > 0.95
    assert np.allclose(*scores, atol=1e-4)


def test_lessons_are_those_of_a_join(spark, odd_docs):
    """Repeated ids and labels count as often as they occur; each part lies sorted in one partition."""
    marks = [(4, 1), (4, 0), (4, 0), (5, 0), (6, 0), (6, 1), (1, 1), (2, 0), (7, 1), (99, 1)]
    rows = spark.createDataFrame(marks, "doc_id long, toxic int").repartition(3)
    got = [tuple(r) for r in toxicity._lessons(odd_docs, rows, 3).withColumn("at", F.spark_partition_id()).collect()]
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3)).cast("int")
    drawn = F.xxhash64(F.xxhash64("doc_id", "text"), "toxic")
    want = odd_docs.join(rows, "doc_id").select(part, F.pmod(drawn, F.lit(5)) == 4, drawn, "lang", "toxic")
    want = [tuple(r) for r in want.collect()]
    assert len(want) > 10 and sorted(want, key=str) == sorted([r[:5] for r in got], key=str)
    assert len({(r[0], r[6]) for r in got}) == len({r[0] for r in got})
    assert [r[:3:2] for r in got] == sorted([r[:3:2] for r in got], key=lambda r: ([g[0] for g in got].index(r[0]), r[1]))


def test_words_are_shuffled_once(spark, odd_docs):
    """Also where the labels are too many to be broadcast."""
    rows = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = toxicity._lessons(odd_docs, rows, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange") == 1


def test_a_pass_averages_what_parts_changed(spark):
    docs = spark.createDataFrame([(i, text, lang, y) for i, (text, y, lang) in enumerate(toy(300, 7))], "doc_id long, text string, lang string, toxic int")
    lessons = toxicity._lessons(docs, docs.select("doc_id", "toxic"), 3).cache()
    values, squares = toxicity._start(11)
    total, n = np.zeros((len(values), 2 * toxicity.DIMENSIONS)), np.zeros(len(values))
    for part in range(3):
        own, seen = values.copy(), squares.copy()
        rows = [toxicity.Lesson(*toxicity._buckets(r["words"]), r["toxic"], 1.0) for r in lessons.where(f"part = {part}").collect()]
        for at in range(0, len(rows), toxicity.BATCH):
            toxicity._step(own, seen, rows[at : at + toxicity.BATCH], 0.1)
        changed = (seen != squares).any(axis=1)
        total[changed] += np.hstack([own, seen])[changed]
        n += changed
    want = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], np.hstack([values, squares])).astype(np.float32)
    toxicity._pass(lessons, values, squares, (1.0, 1.0), 0.1)
    lessons.unpersist()
    assert n.max() == 3 and (np.hstack([values, squares]) == want).all()


def test_changes_are_packed_without_loss():
    r = np.random.Generator(np.random.PCG64(8))
    start = (r.standard_normal((3000, 24)) * 0.1).astype(np.float32)
    rows = np.r_[0, 5:900, 1023, 2048:2900, 2999]  # none in the second block but its neighbours' ends
    own = start.copy()
    own[rows] += (r.standard_normal((len(rows), 24)) * 1e-4).astype(np.float32)
    own[5, :3] = -0.0, np.inf, np.nan
    cells = list(toxicity._packed(rows, own, start))
    got = [toxicity._unpacked(block, cell, start) for block, cell in cells]
    assert [block for block, _ in cells] == [0, 2] and (np.concatenate([g[0] for g in got]) == rows).all()
    assert (np.concatenate([g[1] for g in got]).view(np.uint32) == own[rows].view(np.uint32)).all()
    assert sum(len(cell) for _, cell in cells) < 0.75 * own[rows].nbytes
    assert not list(toxicity._packed(rows[:0], own, start))


def test_thresholds_by_ranges_of_logits(spark):
    r = np.random.Generator(np.random.PCG64(2))
    z = np.round(r.standard_normal(900) * 2, 1)  # with ties
    y = (r.random(900) < 1 / (1 + np.exp(-z))).astype(int)
    lang = r.choice(["aa", "bb", "cc", ""], 900, p=[0.5, 0.4, 0.02, 0.08])
    rows = [(None if name == "" else str(name), int(a), float(b)) for name, a, b in zip(lang, y, z)]
    judged = spark.createDataFrame(rows, "lang string, toxic int, z double")
    p, one = toxicity._sigmoid(0.7 * z - 0.2), np.ones(900)
    want = {None: toxicity._best_threshold(p, y, one)}
    want |= {name: toxicity._best_threshold(p[lang == name], y[lang == name], one[lang == name]) for name in ("aa", "bb")}
    for range_rows in (50, 1000):
        got = toxicity._thresholds(judged, 900, 0.7, -0.2, range_rows)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_toxicity_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (None, 1), (8, None), (99, 1), (9, 0)], "doc_id long, toxic int")
    m = toxicity.trained(odd_docs, labels, F.lit(True))
    rows = toxicity.scored(odd_docs, m).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    one = toxicity.trained(odd_docs, labels.where("toxic = 0"), F.lit(True))
    assert all(r["score"] < 0.01 for r in toxicity.scored(odd_docs, one).collect())
    assert toxicity.scored(no_docs, m).count() == 0
    none = toxicity.trained(odd_docs, labels.where("false"), F.lit(True))
    assert toxicity.scored(odd_docs, none).count() == 12


@pytest.fixture(scope="module")
def page_model():
    return pages.trained()


def test_pages_of_other_layouts(page_model):
    test = pages.labelled_pages(120, seed=1234)
    right = wrong = missed = 0
    for page, label in test:
        own = pages.blocks(page)
        got = set(pages.main_text(page, page_model).split("\n"))
        for b in own:
            main = label.get(b.text.removeprefix("© "), 0)
            right += main == (b.text in got)
            missed += main and b.text not in got
            wrong += not main and b.text in got
    assert right / (right + wrong + missed) > 0.97


def test_real_markup(page_model):
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
    <body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy this now.</div><article><h1>Head&nbsp;line &lt;one&gt;</h1><p><b>Bold   first<br><p>Second
    paragraph, with <i>an</i><a href='x>y'>inner</a> link &#233;.</p><div class="ad">Buy that too.</div><p>Last words of it.</article>
    <section class="comments"><p>I liked this article very much, thanks.</p></section><footer>&copy; someone</footer>"""
    assert pages.main_text(page, page_model) == "Head line <one>\nBold first\nSecond paragraph, with aninner link é.\nLast words of it."


def test_viterbi_equals_search(page_model):
    r = random.Random(4)
    for n in range(1, 9):
        emit = [r.uniform(-2, 2) for _ in range(n)]

        def value(labels):
            s = sum(e for e, x in zip(emit, labels) if x) + labels[0] * page_model.start
            return s + sum(page_model.turn[a, b] for a, b in zip(labels, labels[1:]))

        best = max(([int(c) for c in f"{k:0{n}b}"] for k in range(2**n)), key=value)
        assert pages.decode(emit, page_model) == best


def test_page_edges(spark, page_model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text only"), (4, "u", "<p>"), (5, "u", "</div></p><<>>&"), (5, "u", "<p>" * 20000), (6, "u", "<article><p>" + "Word. " * 50000)]
    rows += [(7, "u", x * 30000) for x in ("<a ", "<!", "<script ", "<div class='x'>y", "<p title=\"")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text")
    got = pages.extracted(df, page_model).collect()
    assert len(got) == 12 and all(r["text"] is not None for r in got)
    assert next(r for r in got if r["page_id"] == 6)["text"] == ("Word. " * 50000).strip()
    assert pages.extracted(df.where("false"), page_model).count() == 0


def test_pages_table(spark):
    """Articles of the test table, cut out by their tag."""
    import html
    import re

    from sumtrace.llm.queries import op9_pages

    got = {r["page_id"]: r for r in op9_pages(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
