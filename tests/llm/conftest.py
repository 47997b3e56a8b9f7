import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(30_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"

ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4),
    (4, LONG, "en", "b", len(LONG)), (5, SAME, "en", "b", len(SAME)), (5, SAME, "en", "b", len(SAME)),
    (6, SAME, "de", None, len(SAME)), (None, SAME + " and more of it at the end", None, "a", 1),
    (7, "short", None, "c", 5), (8, "ключ на русском языке здесь", None, "c", 5)]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
#: names that operators use inside
CLASHES = ("node", "size", "score", "copies", "s", "key", "keys", "label", "class_id", "chunk", "spans", "own",
           "rate", "cut", "band", "kept", "row", "host", "rule", "head_id", "head_node")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
