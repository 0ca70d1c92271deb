import pytest

#: Documents with every hard case; the extra columns bear names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, id long, n long, node string, block int, key int, size int, content string, digest string, score double"


@pytest.fixture(scope="session")
def hard_rows():
    long = " ".join(f"w{i % 997}x" for i in range(30_000))
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight"),
        (3, "The quick  brown fox\tjumps over the lazy dog and runs away from the big bad wolf today"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "One two"),
        (9, long),
        (10, long + " end"),
        (11, "aaaa" * 5000),
        (12, "émile zählt  ½ ①\n\n日本語 テスト\x0bfoo\x1cbar <|endoftext|> </s> ▁x"),
        (13, "one two"),
        (13, "one two"),
        (None, "a row without an id, which stays where it is"),
        (None, "one two"),
        (14, "don't 's 're  12 345   x\r\ny "),
        (15, "emoji 😀😀 and trailing   "),
    ]
    return [(i, t, "en", "s", 7, 7, "x", 7, 7, 7, "x", "x", 0.5) for i, t in texts]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
