import pytest


@pytest.fixture
def docs(spark):
    """Rows as documents with extra columns whose names clash with the operators' own."""

    def make(rows, partitions=3):
        full = [(*r, *[None] * (4 - len(r)), "x", 7, True) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, digest string, key bigint, kept boolean").repartition(partitions)

    return make
