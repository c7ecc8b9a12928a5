import pytest


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like results."""
    long = " ".join(f"w{i % 977}" for i in range(30_000)) + " " + "x" * 5_000
    rows = [
        (1, "the cat sat on the mat and the cat sat on the mat again", "en", "a", 1, 5, "x", "y"),
        (2, "", "en", "a", 0, 5, "x", "y"),
        (3, None, None, None, None, None, None, None),
        (None, "le chat est sur la table avec un autre chat 123", "fr", None, 2, 5, "x", "y"),
        (4, long, "en", "b", len(long), 5, "x", "y"),
        (5, long, "en", "b", len(long), 5, "x", "y"),
        (5, long, "en", "b", len(long), 5, "x", "y"),
        (6, "\u65e5\u672c\u8a9e \U0001f600 \u00fcber \x0b tab\tline\n\nline", "de", "c", 3, 5, "x", "y"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, same string, spans string")
