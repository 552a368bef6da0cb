import pytest

LONG = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam " * 4000
#: Missing and repeated identifiers and texts, ties, long words, odd characters; columns whose names operators use inside.
ROWS = [
    (None, None), (None, "no identifier but words here to read"), (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "same text of five words here"),
    (5, "same text of five words here"), (6, "same  text of five\nwords here"), (7, LONG), (8, LONG), (9, "x" * 5000), (10, "Ünïcödé ▁ \U0001f642 \u0000   text"),
    (11, "the quick brown fox jumps over the lazy dog while nobody looks at all"), (12, "THE quick brown fox jumps over the lazy dog while nobody looks at all"),
]
CLASHES = ("id", "node", "token", "tokens", "score", "ids", "blob", "row", "keep", "digest", "n", "component_id", "text_hash", "decoded", "kind", "lang_pred", "low", "salt")


@pytest.fixture(scope="session")
def edge_docs(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for c in CLASHES:
        docs = docs.selectExpr("*", f"'x' AS `{c}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
