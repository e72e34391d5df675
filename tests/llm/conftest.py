import pytest

from gradebook.llm.workers import ship

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, hash string, node string, _q string"


@pytest.fixture(scope="session", autouse=True)
def on_path(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names the operators use inside."""

    def frame(texts):
        rows = [(i, t, ("en", "fr", None)[k % 3], ("a", "b", None)[k % 3], None, "w", "h", "n", "q") for k, (i, t) in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return frame
