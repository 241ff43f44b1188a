import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rk string, score string, spans string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty texts, repeated rows, ties, long words, and columns whose names the operators use themselves."""
    body = "Under the MIT license, " + " ".join(f"word{i % 37} et la" for i in range(300))
    rows = [
        (1, body), (2, body), (2, body), (3, None), (4, ""), (5, "   \n "), (6, "x"), (7, "ÄÖ ß 日本 🙂"), (8, "a" * 3000), (9, body + " tail"), (None, "no id at all"), (10, "1234 5678"), (11, "one two three four five six seven eight nine ten eleven twelve"),
    ]
    return spark.createDataFrame([(i, t, None if i == 1 else "en", "s", None, "x", "y", "z") for i, t in rows], DOCS)


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Write tables and give their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
