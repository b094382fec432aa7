from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHES = ["_id", "_dropped", "key", "hash", "doc", "size", "node", "copies", "kept", "keep_id", "rep", "n", "label", "component", "ids", "score", "row"]
LONG = " ".join(f"w{i % 977}" for i in range(60_000))

EDGE_ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " Alpha beta\tgamma delta\nepsilon zeta eta ", "en", "b"), (5, " \t\n", None, "b"),
    (6, "Über süße Straßen gehen wir 漢字 ﷽ 😀 weiter und weiter", "de", "a"), (7, LONG, "en", "a"), (8, LONG + " end", "en", "a"), (9, "one", "de", None), (10, "1 2 3 4 5 6 7 8", "en", "c"), (11, "\\<|im_end|> <|x|>", "en", "c"),
]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank, very long, accented and repeated texts, and columns whose names operators use themselves."""
    return with_clashes(spark.createDataFrame([(*r, 0) for r in EDGE_ROWS], SCHEMA)).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def middle_dir():
    return "/root/testdata/sf0.01"
