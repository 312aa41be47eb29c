import random

import pytest

# Columns whose names the operators use for themselves.
CLASHING = ["id", "key", "fp", "digest", "tokens", "posterior", "rate", "route", "spans", "piece", "length", "_text", "_row", "label", "n_words", "kept", "words"]
WORDS = {
    "en": "the of and to in that it is was for on with as this they from have house water people thing".split(),
    "fr": "le la les une des que pour dans est avec sur elle au nous maison été être père où très".split(),
    "de": "der die das und ist nicht ein mit auf für über schön straße haus wasser größe auch wird".split(),
}


def prose(seed, lang="en", sentences=4):
    r = random.Random(seed)
    return " ".join(" ".join(r.choices(WORDS[lang], k=r.randint(5, 12))).capitalize() + "." for _ in range(sentences))


def documents(spark, rows):
    """Rows (doc_id, text, lang) as documents with further columns of clashing names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, lang, "s0" if i else None, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, lang in rows], schema)


HARD = [
    (1, None, "en"), (2, "", "fr"), (3, " \t\n\x0b\f\r ", None), (4, "A", "en"), (5, "a", "en"), (6, "12 34 !?", "de"),
    (7, "É é ß 漢字 \U0001F600", None), (8, prose(1), "en"), (8, prose(1), "en"), (9, prose(1).upper(), "en"), (10, prose(2, "fr"), "fr"),
    (11, "word " * 30_000, "en"), (12, prose(3, "de", 3000), "de"), (13, "x" * 150_000, None), (14, "a b\n" * 400, "en"), (None, prose(5), "en"),
    (15, "no\x00break\xa0here\u2028and ▁ <|endoftext|> <s>", None),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns."""
    return documents(spark, HARD)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """A folder of tables to run queries on."""
    return "/root/testdata/sf0.001"
