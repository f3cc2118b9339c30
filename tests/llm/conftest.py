import pytest
from pyspark.sql import functions as F

LONG = "Lorem ipsum dolor sit amet. " * 3000


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return sorted(map(tuple, documents.select("doc_id", "text").collect()))


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and languages, empty and very long texts, repeated rows, and columns named as results are."""
    rows = [
        (1, None, "en", "a", "x"),
        (2, "", "en", None, "x"),
        (3, " \n\t ", None, "a", None),
        (4, LONG, "en", "a", "x"),
        (5, LONG, "en", "a", "x"),
        (5, LONG, "en", "a", "x"),
        (None, LONG, None, None, None),
        (None, None, None, None, None),
        (6, "one", "de", "a", "x"),
        (7, "ÉÀ漢字 <|endoftext|>   \x1c İΣ '", "fr", "b", "x"),
        (8, "one", "de", "a", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    extra = ("kept", "ids", "decoded", "item_ids", "clean_text", "n_hit", "__spans", "score", "n_tokens", "digest", "start", "stop", "hash", "rep", "component_id", "base_failed", "row")
    return df.withColumns({c: F.lit("clash") for c in extra}).cache()
