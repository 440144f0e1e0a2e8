import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, place int, bands string, done string, prefix string"


def extra(rows):
    """Rows (doc_id, text, lang, source) with columns whose names operators use themselves."""
    return [(i, t, lang, s, None if t is None else len(t), 1, "x", 2, "y", "no", "p") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, a long text, ties, repeated rows, copies, a null id."""
    words = " ".join(f"word{i % 977}x{i}" for i in range(3000))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", None), (4, "one", "en", None), (5, words, "en", "a"), (6, words, "en", "b"),
        (7, "start " + passage + " end", "fr", "b"), (8, "other " + passage + " tail", "fr", "b"), (None, passage, "fr", "b"), (9, "é ü ñ " * 30, "es", "c"), (10, "x" * 5000, "en", "c"), (11, "a b c d", "de", "c"), (12, "a b c d", "de", "c"), (4096, "far away", "de", "c"), (-3, "minus three", "de", "c"),
    ]
    return spark.createDataFrame(extra(rows), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
