import random

import pytest

CLASHING = "ids n_tokens score n_lines n_dropped group label block node root term spans text_hash size doc bands".split()


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = " ".join(word() for _ in range(60))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6000))
    return [
        (1, ""), (2, None), (3, "one two"), (3, "one two"), (3, "another text of the same id"),
        (None, "no id but a text of some words"), (None, None), (7, prose), (8, prose), (9, prose + " end"),
        (10, long), (11, " \n\t \n"), (12, "!!! ... ###"), (13, "ends in newline\n"), (14, "x" * 120_000 + "y" * 9),
        (15, "emoji 😀 naïve Straße ÀÉ"), (16, "one two"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The same with extra columns named like columns that operators use inside."""
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([(*r, *[None] * len(CLASHING)) for r in edge_rows], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
