import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, grp string"


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame of (doc_id, text[, lang[, source]]) rows with extra columns of clashing names."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), None, "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build
