import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture(scope="session")
def docs(spark):
    """A DataFrame of documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(rows, extra=()):
        fields = [StructField("doc_id", LongType()), StructField("text", StringType())]
        fields += [StructField(c, StringType()) for c in extra]
        data = [(i, t, *["x"] * len(extra)) for i, t in rows]
        return spark.createDataFrame(data, StructType(fields))

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that tokenizers and word rules see differently, and plain ones."""
    r = random.Random(7)
    letters = " \n\t  ab.'sÉé\x02 \x1c 1Z!,\x85€中́\xa0"
    texts = ["", " ", "\n", "a", "the idiot's  end. ", "<|endoftext|> x", "a" * 3000, "word " * 2500, None]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(300)]
    words = ["the", "Erst", "ndnt", "éau,", "of.", "9", "--"]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(60)]
    return texts
