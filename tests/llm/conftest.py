"""Small document tables with the awkward cases every operator must handle."""

import pytest
from llm_helpers import SF, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, copies, a hot source, clashing extra columns."""
    base = words(120, 1)
    rows = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, base.upper(), "en", "src1"), (4, base + " tail words", "en", "src0"),
        (5, None, "en", "src0"), (6, "", "fr", "src1"), (7, " \n\t ", None, "src2"), (None, words(80, 2), "de", None), (None, None, None, None),
        (8, words(9000, 3), "en", "src0"), (9, "one two three", "es", "src2"), (9, "one two three", "es", "src2"), (10, "same\nsame\nsame\n" + words(60, 4), "en", "src1"),
        (11, words(70, 5) + "\x0b\x0cend\xa0of ​text", "en", "src0"), (12, "<|endoftext|> " + words(60, 6), "en", "src0"), (13, "été À çà ÑANDÚ " + words(60, 7), "fr", "src1"),
    ]
    rows += [(100 + i, words(60 + i, 100 + i), "en", "src0") for i in range(60)]
    df = spark.createDataFrame([(a, b, c, d, len(b) if b else 0) for a, b, c, d in rows], SCHEMA)
    from pyspark.sql import functions as F

    for name in ("shard", "size", "kept", "words", "host", "label", "length", "bucket", "row", "tokens", "n", "failed", "key", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
