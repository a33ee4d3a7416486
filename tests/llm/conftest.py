import tempfile

import pytest

WORD_LETTERS = "abcdefgh"


@pytest.fixture
def table_of(spark):
    """A written table of the given rows, in three files."""

    def make(rows, schema):
        path = tempfile.mkdtemp(prefix="llm-") + "/rows"
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
