import pytest

from tremorlake.llm.common import release


@pytest.fixture(autouse=True, scope="module")
def _release():
    yield
    release()


@pytest.fixture
def documents(spark):
    """A documents table with an extra, clashing column."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, label string"

    def table(*rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", "y", "z") for i, t, lang, source in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return table
