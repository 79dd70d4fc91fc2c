import pytest

#: A tiny corpus with the awkward cases: null and empty texts, a very long one, ties, repeated rows, null ids and
#: sources, and columns named like the operators' own.
LONG = "lorem ipsum dolor " * 30_000


def corpus_rows():
    rows = [(i, f"word{i} of document number {i} says hello to reader {i % 7}\nline two {i}", "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, None, "en", "s0"), (101, "", "en", None), (102, " \n\t ", None, "s1"), (103, LONG, "en", "s2"),
             (104, "same text here for two", "en", "s0"), (105, "same text here for two", "en", "s1"),
             (106, "repeated row of five words", "en", "s3"), (106, "repeated row of five words", "en", "s3"),
             (None, "no id at all but text", "en", "s2"), (107, "naïve “quotes” 😀 \u2028 \u00a0 ▁ ＡＢ\x00 end", "xx", "é")]
    return [(*r, "row", 1, 2, "k", "fp") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, row string, size int, h int, key string, fp string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(corpus_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
