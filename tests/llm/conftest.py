import pytest

from casewright.llm.common import Workspace


@pytest.fixture
def ws(spark):
    space = Workspace(spark, "test")
    yield space
    space.drop()


ODD = [None, "", " ", "\n\t ", "a", "a", "a  b\n", " a b ", "é ▁ 日本", "x" * 30_000, "w " * 9_000, "\x00\x01 \x1f"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", i, "q", 1) for i, t in enumerate(ODD)]
    rows += [rows[5], rows[5], (None, "a", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, row int").withColumnsRenamed({"label": "key", "row": "size"})
