import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, fp string, th long, row_ string, h_ long, size string, key string, found string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and white texts, a very long text, repeated rows and ids, ties, several scripts."""
    rng = random.Random(5)
    passage, base = words(rng, 60), words(rng, 200)
    rows = [
        (1, None, "en", "s0"), (2, "", "en", None), (3, " \n\t ", None, "s0"), (None, words(rng, 40), "fr", "s1"), (None, None, None, None), (4, words(rng, 30000), "en", "s0"), (5, base, "en", "s0"), (5, base, "en", "s0"),
        (5, base, "en", "s0"), (6, base, "en", "s1"), (7, base + " end", "en", "s1"), (8, words(rng, 50) + " " + passage + " " + words(rng, 50), "en", "s2"), (9, words(rng, 9) + " " + passage + "\n" + words(rng, 80), "de", "s2"),
        (10, passage[3:], "de", "s2"), (11, "ab " * 400, "es", "s0"), (12, "x", "es", "s0"), (13, "Ünïcode ‹文字› Привет мир \U0001f600 " * 30, "fr", "s3"), (14, "one two", "en", "s0"), (15, "one\ntwo", "en", "s0"),
        (15, words(rng, 25), "en", "s9"), (16, "a" * 5000, "en", "s0"), (17, "<|endoftext|> is text", "en", "s0"), (18, "\x00 \x0b nul", "en", "s0"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The rows with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "c", "c", "c", 1, "c", 1, "c", "c", "c") for r in edge_rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
