import pytest

LONG = " ".join(f"word{k % 977} of" for k in range(30_000))

#: Null, empty, blank, very long, repeated and odd texts; ids with nulls and ties.
CASES = [
    (1, "The quick brown fox jumps over the lazy dog. It's 12345!"),
    (2, None),
    (3, ""),
    (4, "   "),
    (5, LONG),
    (6, "same text here for all of them"),
    (6, "same text here for all of them"),
    (7, "same text here for all of them"),
    (None, "an id that is null"),
    (None, None),
    (8, "tabs\tand\r\nlines\n\n and  runs   of spaces   　 end "),
    (9, "naïve Ünïcode ́ ﬁ 😀 ▁mark ▁▁ a\x00b <|im_end|> <|endoftext|> |"),
    (10, "\n"),
    (-5, "negative id"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The cases with columns whose names operators use inside, too."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "src0", k, k) for k, (i, t) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long, _row_key int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
