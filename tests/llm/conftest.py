import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text) pairs, with the other columns, some of them null, and columns with clashing names."""

    def make(rows):
        base = spark.createDataFrame(rows, "doc_id long, text string")
        return base.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.concat(F.lit("s"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))).alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("size"), F.lit("k").alias("key"), F.lit(0).alias("ids_"))

    return make


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (4, "one"), (None, "no id here"), (5, "word " * 20000), (6, "é😀 \x00 tail\t"), (7, "a" * 30000)]


@pytest.fixture(scope="session")
def odd():
    return ODD
