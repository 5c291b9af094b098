import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

#: Awkward rows: nulls in every column, empty and blank texts, repeated rows, one long text.
AWKWARD = [
    (1, None, "en", "a", 5), (2, "", "en", "a", 0), (3, "  \t\n", None, None, None), (4, "the cat sat on the mat", "en", "b", 22),
    (4, "the cat sat on the mat", "en", "b", 22), (None, "the cat sat on the mat", "en", None, 22),
    (5, "12 34 !!", "de", "a", 8), (6, "der hund und die katze " * 4000, "de", "b", 92000), (None, None, None, None, None),
    (7, "ß", "de", "c", 1), (-8, "THE CAT SAT ON THE MAT", "en", "c", 22),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward documents, with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCUMENTS)
    clashing = ["rid", "sid", "n", "key", "h1", "h2", "score", "size", "slot", "gid", "salt", "_b", "words_of", "held_out",
                "label", "root", "digest", "block", "times", "copy", "u", "v", "spans", "n_words", "target"]
    return df.select("*", *[F.lit("x").alias(c) for c in clashing])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
