import pytest
from pyspark.sql import types as T

HOSTILE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("digest", "shard", "n_words", "statistics", "features", "fp", "word", "term", "host", "n")]
)
LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows and ids, columns named like inner ones."""
    extra = ("x",) * 9 + (None,)
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away, says The Fox."), (2, None), (None, "no id at all"), (None, None),
        (3, ""), (4, " \t\n\r "), (5, LONG), (6, "same text"), (6, "same text"), (7, "same text"), (8, "write to a.b@example.com or +1 (212) 555-0199 !"),
        (9, "ärger über ÉTÉ 日本 😀\x00"), (6, "other text of id six"), (10, "you idiot " * 30),
    ]
    return spark.createDataFrame([(i, t, *extra) for i, t in texts], HOSTILE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], HOSTILE)


@pytest.fixture(scope="session")
def sf(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
