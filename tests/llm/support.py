"""What the tests of the training-data operators share."""

import pytest

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture
def docs(spark):
    """Documents (doc_id, text), with further columns of clashing names."""

    def make(rows):
        schema = "doc_id bigint, text string, key bigint, n bigint, body string, fp string, kind string"
        return spark.createDataFrame([(i, t, None, 1, "x", None, "y") for i, t in rows], schema)

    return make


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
