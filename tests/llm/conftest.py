import pytest

#: Rows with nulls, empties, repeats, ties and clashing extra columns.
ODD = [
    (5, "plain words stand here", "en", "a", 1), (3, None, None, None, None), (None, "no id  two  spaces\n", "fr", "b", 3), (7, "", "de", "a", 0),
    (5, "plain words stand here", "en", "a", 1), (9, "é ü 漢字 \U0001f600 !!", "es", "b", 9), (11, "x " * 5000, "en", "a", 10000), (12, " \t\n ", None, "c", 4),
    (13, "plain  words\nstand here ", "en", "c", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("clash") for c in ("score", "keep_id", "key", "size", "n", "ids", "part", "target", "taken", "digest", "rank", "file", "row", "pcm", "pcm_rate", "words", "media", "__row", "__maybe", "__map")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
