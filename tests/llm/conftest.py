import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} thing{i % 31}, again." for i in range(20000))


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(r.randrange(40))
                    for _ in range(n))


def edge_rows():
    a, b = prose(1, 80), prose(2, 60)
    texts = [(1, a), (2, a), (2, a), (3, b), (3, prose(3, 70)), (None, a), (None, None), (None, None), (4, None), (5, ""), (6, " \t\n"), (7, "one"),
             (8, "one two three"), (9, LONG), (10, "é ß 漢字 😀 " + b), (11, a + " " + a), (12, "x " * 300), (-5, a + " tail"), (13, "A\nB\nA\n\nA")]
    return [(i, t, None if k % 3 else "en", None, None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["node", "tag", "key", "bucket", "spans", "label", "score", "n_words", "id", "h", "row", "runs", "bands", "class_id", "value"]
    return edge_docs.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
