import pytest
from pyspark.sql import types as T

from seqdrift.llm.base import shipped

COLUMNS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def table(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, lang, source)."""
    shipped(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")

    def make(rows, partitions=2):
        full = [(*r, *(None, None)[len(r) - 2 :])[:4] for r in rows]
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in full]
        return spark.createDataFrame(full, COLUMNS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977} other{i % 13}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (None, None), (None, "no id here"), (4, "one"), (5, "one"), (5, "one"),
        (6, long), (7, long + " tail"), (8, "é ü 日本 … #*$%"), (9, "x" * 5000), (10, "a\nb\na\nb\n\n"),
    ]
