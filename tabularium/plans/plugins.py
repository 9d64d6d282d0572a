"""Contract queries of the plug-ins, and of inputs that other queries build from columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.dense import model_embedder
from tabularium.operators.rerank import model_scorer, rerank
from tabularium.plans.contract import contract, read
from tabularium.session import shared_path
from tabularium.sources.delimited import header_names
from tabularium.sources.documents import parse_documents, read_files
from tabularium.sources.tablestore import FILES, TableStore


@contract(
    "binary_files",
    """SELECT source, sum(strlen(text) + 1)::BIGINT AS file_size, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS file_hash
    FROM documents GROUP BY source""",
)
def binary_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files scanned as bytes with their hash and size; each holds one source's texts."""
    path = shared_path(spark, "files")
    documents = read(spark, sf, "documents").select("source", "doc_id", "text")
    documents.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(path)
    files = read_files(spark, path, "part-*")
    return files.select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), F.col("file_size").cast("long").alias("file_size"), "file_hash")


@contract(
    "positional_headers",
    """SELECT doc_id, source || ',col_1,' || lang || ',' || source || '_2,' || lang || '_2,' || source || '_3,t' || doc_id || ',col_7' AS names FROM documents""",
)
def positional_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Column names of header records: missing ones by position, repeated ones numbered."""
    headers = F.array("source", F.lit(None), "lang", F.upper("source"), "lang", F.concat("source", F.lit("!")), F.concat(F.lit(" T"), "doc_id"), F.lit(None))
    return read(spark, sf, "documents").select("doc_id", F.array_join(header_names(headers), ",").alias("names"))


def _letter_counts():
    """A stand-in model: length and counts of three letters."""

    def model(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), *(float(t.count(c)) for c in "aeo")] for t in texts]

    return model


@contract(
    "plugin_embedder",
    """SELECT doc_id, length(text)::DOUBLE AS x0, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS x1,
    (length(text) - length(replace(text, 'e', '')))::DOUBLE AS x2, (length(text) - length(replace(text, 'o', '')))::DOUBLE AS x3 FROM documents""",
)
def plugin_embedder(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of an embedder plug-in, called with bounded batches of texts."""
    vectors = read(spark, sf, "documents").select("doc_id", model_embedder(_letter_counts, batch=7)(F.col("text")).alias("v"))
    return vectors.select("doc_id", *[F.col("v")[i].cast("double").alias(f"x{i}") for i in range(4)])


def _length_ratio():
    """A stand-in pair model: how alike two texts are in length."""

    def model(queries: list[str], texts: list[str]) -> list[float]:
        return [min(len(q), len(t)) / max(len(q), len(t), 1) for q, t in zip(queries, texts, strict=True)]

    return model


@contract(
    "plugin_scorer",
    """WITH scored AS (
      SELECT b.item_id AS query_id, d.doc_id AS id, d.doc_id AS first_rank,
             round(least(length(b.text), length(d.text))::DOUBLE / greatest(length(b.text), length(d.text), 1), 6) AS score
      FROM benchmark b JOIN documents d ON d.doc_id % 50 = b.item_id % 50)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank)::INT AS rank
    FROM scored QUALIFY rank <= 4""",
)
def plugin_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates reranked by a pair-model plug-in."""
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.pmod("item_id", F.lit(50)).alias("lot"))
    documents = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").cast("int").alias("rank"), F.pmod("doc_id", F.lit(50)).alias("lot"))
    return rerank(asked.join(documents, "lot"), 4, model_scorer(_length_ratio, batch=5)).select("query_id", "id", "score", "rank")


@contract(
    "plugin_parser",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 2 END AS blocks, CASE WHEN doc_id % 7 = 0 THEN 'no layout' END AS error,
    CASE WHEN doc_id % 7 <> 0 THEN md5(lang || '|' || text) END AS content FROM documents""",
)
def plugin_parser(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a format that only a parser plug-in reads; some of them break it."""

    def parser(content: bytes, path: str) -> list[tuple[list[str], str, int | None]]:
        language, text = content.decode().split("|", 1)
        if int(path.split("/")[1].split(".")[0]) % 7 == 0:
            raise ValueError("no layout")
        return [(["Language"], language, 1), ([], text, 2)]

    content = F.concat_ws("|", "lang", "text").cast("binary")
    files = read(spark, sf, "documents").select(
        F.concat(F.lit("in/"), "doc_id", F.lit(".layout")).alias("path"), F.md5(content).alias("file_hash"), F.octet_length(content).alias("file_size"), content.alias("content")
    )
    parsed = parse_documents(files, parser)
    blocks = F.col("blocks")
    return parsed.select(
        F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), F.size(blocks).alias("blocks"),
        F.regexp_extract(F.get("errors", F.lit(0))["error_message"], "no layout", 0).alias("error"),
        F.when(F.size(blocks) > 0, F.md5(F.array_join(F.transform(blocks, lambda b: b["text"]), "|"))).alias("content"),
    )


@contract(
    "plugin_describer",
    """SELECT 'customer' AS table_name, 'Customers by their segment' AS description, 'c_custkey TEXT the key,c_acctbal REAL ,c_mktsegment TEXT ' AS columns,
    c_custkey::VARCHAR AS c_custkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT 'supplier', 'Table from supplier.csv', 's_suppkey INTEGER ,s_acctbal REAL ', s_suppkey::VARCHAR, s_acctbal, NULL FROM supplier""",
)
def plugin_describer(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions and types from a describer plug-in, which answers for one of two tables."""
    files = []
    for table, columns in (("customer", ["c_custkey", "c_acctbal", "c_mktsegment"]), ("supplier", ["s_suppkey", "s_acctbal"])):
        path = shared_path(spark, table)
        read(spark, sf, table).select(*columns).write.option("header", "true").csv(path)
        files.append((path, f"in/{table}.csv", "h"))
    store = TableStore(spark, shared_path(spark, "tables"))
    told = '{"description": "Customers by their segment", "columns": [{"name": "c_custkey", "type": "text", "description": "the key"}, {"name": "c_acctbal", "type": "money"}]}'
    reply = store.ingest_all(spark.createDataFrame(files, FILES), lambda card: F.when(F.contains(card, F.lit("c_custkey")), F.lit(told)).otherwise(F.lit("Sorry")))
    ids = {r["table_name"]: r["table_id"] for r in reply.collect()}
    spelled = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"], c["description"])), ",")
    known = store.schemas(list(ids.values())).select("table_name", "description", spelled.alias("columns"))
    customers = store.read(ids["customer"]).select(F.lit("customer").alias("table_name"), "c_custkey", "c_acctbal", "c_mktsegment")
    suppliers = store.read(ids["supplier"]).select(F.lit("supplier").alias("table_name"), F.col("s_suppkey").cast("string").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return known.join(customers.unionByName(suppliers), "table_name")
