"""Contract queries of delimited files: many at once, and one in many splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.plans.contract import contract, read
from tabularium.session import shared_path
from tabularium.sources.delimited import read_delimited, read_records
from tabularium.sources.tablestore import FILES, TableStore


@contract("csv_splits", "SELECT doc_id, md5(text) AS text_md5, n_chars, true AS in_splits FROM documents")
def csv_splits(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files whose cells hold line breaks and quotes, read in splits far smaller than a long cell, many of them by one task."""
    path = shared_path(spark, "csv")
    documents = read(spark, sf, "documents").select("doc_id", "text", "n_chars")
    documents.write.options(
        header="true", escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    session.conf.set("spark.sql.files.openCostInBytes", "1k")
    session.conf.set("spark.sql.files.maxPartitionNum", str(4 * spark.sparkContext.defaultParallelism))
    n_splits = read_records(session, path).select("split").distinct().count()
    cells = read_delimited(session, path)
    return cells.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), F.col("n_chars").cast("long").alias("n_chars"), F.lit(n_splits > 1).alias("in_splits")
    )


# Table, delimiter, key, and its columns with the labels they must get; money is told in cents, texts by their digest.
_FOLDER = {
    "region": (",", "r_regionkey", {"r_regionkey": "INTEGER", "r_name": "TEXT"}),
    "nation": ("\t", "n_nationkey", {"n_nationkey": "INTEGER", "n_name": "TEXT", "n_regionkey": "INTEGER"}),
    "supplier": (",", "s_suppkey", {"s_suppkey": "INTEGER", "s_name": "TEXT", "s_nationkey": "INTEGER", "s_acctbal": "REAL"}),
    "customer": ("\t", "c_custkey", {"c_custkey": "INTEGER", "c_name": "TEXT", "c_nationkey": "INTEGER", "c_acctbal": "REAL", "c_mktsegment": "TEXT"}),
    "part": (",", "p_partkey", {"p_partkey": "INTEGER", "p_name": "TEXT", "p_retailprice": "REAL"}),
    "documents": (",", "doc_id", {"doc_id": "INTEGER", "text": "TEXT", "lang": "TEXT"}),
}


def _folder_sql(table: str, key: str, columns: dict[str, str]) -> str:
    def told(name: str, label: str) -> str:
        value = f"round({name} * 100)::BIGINT" if label == "REAL" else f"md5({name})" if label == "TEXT" else name
        return f"coalesce({value}::VARCHAR, '')"

    content = " || '|' || ".join(told(n, t) for n, t in columns.items())
    return f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS row_count, '{','.join(columns.values())}' AS types, {key}::BIGINT AS key, {content} AS content FROM {table}"


@contract("table_folder", " UNION ALL ".join(_folder_sql(t, k, c) for t, (_, k, c) in _FOLDER.items()))
def table_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Unlike CSV and TSV files, some with line breaks in cells, loaded by one call and read back by table."""
    files = []
    for table, (delimiter, _, columns) in _FOLDER.items():
        path = shared_path(spark, table)
        read(spark, sf, table).select(*columns).write.options(
            header="true", sep=delimiter, escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
        ).csv(path)
        files.append((path, f"in/{table}.{'csv' if delimiter == ',' else 'tsv'}", "h"))
    store = TableStore(spark, shared_path(spark, "tables"))
    reply = store.ingest_all(spark.createDataFrame(files, FILES))
    schemas = store.schemas([r["table_id"] for r in reply.select("table_id").collect()])
    types = schemas.select("table_name", "row_count", F.array_join(F.transform("columns", lambda c: c["type"]), ",").alias("types"))
    readers = store.readers(schemas)

    def rows(table: str, key: str, columns: dict[str, str]) -> DataFrame:
        told = {
            "REAL": lambda name: F.round(F.col(name) * 100).cast("long"), "TEXT": lambda name: F.md5(name), "INTEGER": lambda name: F.col(name),
        }
        content = [F.coalesce(told[label](name).cast("string"), F.lit("")) for name, label in columns.items()]
        return readers[table](spark).select(F.lit(table).alias("table_name"), F.col(key).cast("long").alias("key"), F.concat_ws("|", *content).alias("content"))

    whole = reduce(DataFrame.unionByName, [rows(t, k, c) for t, (_, k, c) in _FOLDER.items()])
    return whole.join(F.broadcast(types), "table_name").select("table_name", "row_count", "types", "key", "content")
