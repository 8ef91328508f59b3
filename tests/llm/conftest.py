import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    base = " ".join(f"wort{i % 37}x{i % 11}" for i in range(400))
    near = base.replace("wort5x5", "anders", 1)
    rows = [
        (1, base, "de", "a"), (2, base, "de", "a"), (3, near, "de", "b"), (4, "  " + base.replace(" ", "\n\t") + " ", None, None),
        (5, None, "en", "a"), (6, "", "en", "b"), (7, " \n\t ", "en", None), (8, "Only two", "en", "c"), (9, "only two", None, "c"),
        (10, "eins zwei drei", "de", "c"), (11, "x" * 300_000, "en", "z"), (12, "the word " * 60_000, "en", "z"),
        (None, base, "de", "a"), (None, None, None, None), (13, "the cat sat on the mat, and went away.", "en", "é"),
        (14, near, "de", "b"), (14, near, "de", "b"), (15, "eins zwei drei vier fünf sechs sieben acht neun", "de", "Z"), (16, "…!?", "fr", "é"),
    ]
    names = "doc_id bigint, text string, lang string, source string, size int, n int, key int, h int, keep int, score int, shard int, count int, rank int, a int, b int, component int, part int, low int, norm int, rate int"
    return spark.createDataFrame([(*r, *[7] * 16) for r in rows], names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
