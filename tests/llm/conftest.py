"""Awkward documents that every operator must take."""

import pytest

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30000)) + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, equal ids, columns named like outputs and helpers."""
    rows = [
        (1, "Hello there, this is the first of some ordinary sentences about nothing at all. It goes on for a while, so that there is enough to say.", "en", "a", 10),
        (1, "Hello there, this is the first of some ordinary sentences about nothing at all. It goes on for a while, so that there is enough to say.", "en", "a", 10),
        (2, "", "en", "a", 0),
        (3, None, "en", None, None),
        (4, " \n\t ", None, "b", 4),
        (None, "a row without an id", "en", "b", 19),
        (5, LONG, "en", "b", len(LONG)),
        (6, "été à la plage, l'eau était très bleue et les enfants jouaient dans le sable", "fr", "c", 70),
        (7, "日本語のテキスト 👍🏽 naïve", "ja", "c", 20),
        (7, "another text of the same id", "en", "c", 27),
        (8, "x", "en", None, 1),
        (9, "12345 67890 ### $$$", None, "a", 19),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extras = {c: "same" for c in ("tokens", "k", "d", "t", "g", "h", "part", "size", "host", "path", "posterior", "perplexity", "lid", "mix_shard", "line", "words")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extras.items()}).persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
