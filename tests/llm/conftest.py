import random

import pytest
from llm.llm_helpers import DOC, words


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Empty, null, blank, very long, repeated and many-byte texts."""
    rng = random.Random(5)
    some = words(rng, 60)
    return ["", None, "   \n\t", some, some, words(rng, 30_000), "a", "ß é 漢字 😀 " * 40, "x" * 5_000, some + " end"]
