from __future__ import annotations

import duckdb
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tools.check import TABLES

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("key", StringType()),
    StructField("id", LongType()), StructField("score", StringType()), StructField("row", StringType()),
])

PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))

# Nulls, empty and very long texts, repeated rows, ties of ids, texts without words.
AWKWARD = [
    (1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "another text with the same id"), (2, None), (3, ""), (None, "no id here"),
    (None, None), (4, "\n\n"), (5, "### $$$"), (6, LONG), (7, f"before it {PASSAGE} after it"), (8, f"elsewhere {PASSAGE}"), (9, "äöü 日本語 🙂 " * 30),
]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 5, "s", "r") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def rows_of_table(small):
    def read(sql: str):
        connection = duckdb.connect()
        for table in TABLES:
            connection.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
        return connection.execute(sql).fetchall()

    return read
