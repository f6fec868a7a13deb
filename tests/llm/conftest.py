import public_tokenizers
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def place():
    return {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns of clashing names."""
    rows = [
        (1, "The cat sat on the mat and then it slept all day", "en", "__key"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", None, "b"),
        (5, "word " * 20_000, "en", "a"), (5, "word " * 20_000, "en", "a"), (6, "The cat sat on the mat and then it slept all day", "en", "c"),
        (7, "one", "de", "a"), (8, "ONE", "de", "a"), (9, "äöü ßé 漢字 🙂  x", "fr", None), (-3, "12345 !!! ...", "es", "a"), (None, "no key here", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "doc_id AS __lane", "text AS __text", "lang AS __lang", "source AS __h")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
