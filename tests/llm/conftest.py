import pytest

#: Texts with every edge: null, empty, blank, short, repeated, long, other scripts, broken marks.
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    long_text = " ".join(WORDS * 200)
    rows = [
        (1, None, None, "x", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", "en", "x", 4),
        (4, "one two three", "en", "x", None),
        (5, " ".join(WORDS[:40]), "en", "x", 1),
        (6, " ".join(WORDS[:40]), None, "x", 1),
        (6, " ".join(WORDS[:40]), None, "x", 1),
        (None, " ".join(WORDS[:40]), "de", "x", 1),
        (None, None, None, None, None),
        (7, long_text, "en", "x", 1),
        (8, "Привет мир, это текст. 你好 <|endoftext|> é́ \u0085 \x1c x", "ru", "x", 1),
        (9, "Über Straße d'accord l'été 12 ½ ²", "fr", "x", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS block", "'a' AS bucket", "2 AS component_id", "3 AS score", "4 AS fp")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
