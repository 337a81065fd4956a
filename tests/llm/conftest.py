import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __rank int, shard string, size string"


def rows_of(texts, langs=None):
    """Documents with extra columns whose names clash with internal ones."""
    return [(i, t, (langs or {}).get(i, "en"), f"s{i % 3}", len(t) if t is not None else None, 7, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture
def make(spark):
    def f(texts, langs=None, rows=None):
        return spark.createDataFrame(rows if rows is not None else rows_of(texts, langs), DOCS).repartition(3)

    return f


EDGE = [None, "", " ", "word", "a b", "x" * 5000, "der die das " * 2000, "a\n\nb\tc", "ünïcode tëxt 漢字 😀", "a b", None]
