import random

import pytest
from corpus_fixtures import DOCUMENTS


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text) pairs."""

    def build(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return build
