import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text[, source]) rows with extra columns whose names clash with internal ones."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        d = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "node", "label", "key", "words", "_copy", "_n", "start", "template", "target", "copies", "score", "w1", "doc", "_words", "text_hash", "_hash"):
                d = d.withColumn(name, F.lit(7))
        return d

    return make


@pytest.fixture(scope="session")
def awkward():
    """NULL and empty texts, a NULL id and source, repeated rows, ties, a very long text."""
    words = [f"w{k % 977}" for k in range(30_000)]
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "a b c d e f g"),
        (8, " ".join(words)), (9, " ".join(words[:29_000])), (None, "null id text here"), (10, "Ünï ÇÖDÉ text ß", None), (11, "All rights reserved. CC-BY 4.0", None),
    ]
