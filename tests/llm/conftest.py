import pytest

WIDE = "doc_id bigint, text string, shard int, score double, token bigint, id bigint, sequence_id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents, with extra columns whose names clash with those that operators use."""

    def build(rows):
        return spark.createDataFrame([(i, t, 7, 0.5, 1, 2, "x") for i, t in rows], WIDE)

    return build


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and blank texts, ties, repeated rows and a long text."""
    long = " ".join(f"word{k % 977} tail{k}" for k in range(30_000))
    return docs([(1, "a b c d e f g"), (2, "A b C d e F g"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (7, "one two"), (None, "a b c d e f g"), (None, None), (8, long), (9, "é " * 50), (10, "<|endoftext|> x  y\n\n z ")])
