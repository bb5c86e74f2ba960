import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("lorem the tion word " * 6_000).strip()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "the same text of a few words here", "en", "a", 33),
        (2, "the same text of a few words here", "en", "a", 33),
        (2, "the same text of a few words here", "en", "a", 33),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (None, "no id at all in this one", "en", "b", 24),
        (5, LONG, "en", "b", len(LONG)),
        (6, " \t\n ", "fr", None, 4),
        (7, "\x00 é ß 漢字 😀 <|endoftext|> password: abcdefghijkl", "de", "c", 10),
        (8, "x" * 30_000, "de", "c", 30_000),
    ]
    extra = "score double, fp long, src string, key string, spans string, Shard int, size string"
    return spark.createDataFrame([(*r, 0.5, 1, "s", "k", "z", 1, "q") for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def folder(tmp_path):
    """Writes tables as the queries read them: folder(name=df, ...) -> path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
