import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def of(*texts, sources=("a",)):
        rows = [
            (i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", sources[i % len(sources)], 0, 1.0, "x", "y")
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return of


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
