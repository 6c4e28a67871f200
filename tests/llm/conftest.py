import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text, ...) rows, with columns whose names clash."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        wide = [(*r, *["x"] * 3) for r in rows]
        return spark.createDataFrame(wide, schema + ", size string, row string, kept string")

    return build
