import pytest

WORDS = "the of and ing ther ation ent ever under stone river blue seven lamp cloud".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    long = " ".join(f"{WORDS[i % 15]}{i}" for i in range(30_000))
    copy = " ".join(f"w{i}" for i in range(200))
    rows = [(1, copy, "en", "a"), (2, copy, "en", "a"), (3, copy + " tail", "en", "a"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "en", None), (7, long, "de", "b"), (8, long, "de", "b"), (None, copy, None, "a"), (None, None, None, None), (9, "one two", "en", "a"), (9, "one two", "en", "a"), (10, "the the the " * 60, "en", "b"), (11, "h#sh m%rk " + copy, "fr", "c")]
    out = [(*r, r[0], "x", 1, None, [1], "y") for r in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, w string, row int, id string, bands array<int>, kept string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
