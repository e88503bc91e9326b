"""Small tables with nulls, empties, ties, repeated rows and clashing names."""

import pytest

WORDS = ("der hund lief schnell und the quick brown fox jumps over lazy dogs while rain falls softly on "
         "quiet hills beyond our small village where nobody sleeps tonight").split()


def sentence(i: int, n: int = 40) -> str:
    return " ".join(WORDS[(i * 7 + j * j + j // 3) % len(WORDS)] + (str(i) if j % 9 == 0 else "") for j in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): the rows every operator must live with."""
    base = [(i, sentence(i)) for i in range(20)]
    return base + [
        (100, None), (101, ""), (102, "   \n\t "), (103, "a"), (104, sentence(3)), (105, sentence(3).replace(" ", "\n  ")),
        (106, "x" * 30_000), (107, "word " * 9_000), (108, "<|endoftext|> <s> </s> <0x0A> \x00 \u2581 e\u0301 H\u0331 \x85 \xa0"),
        (109, "\u4e2d\u6587 \U00013000 caf\u00e9 \u00c9T\u00c9 'S don't !!! \u2026 1234"), (None, sentence(5)), (None, None),
        (7, sentence(7)), (7, "another text with the same id"), (110, sentence(1) + " one more word"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"n": F.lit("x"), "node": F.lit(1), "score": F.lit(None).cast("double"), "sha": F.lit("s"),
                           "row": F.lit(2), "lang": F.lit("en"), "head": F.lit("h"), "salt": F.lit(0), "ids": F.lit(9)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
