"""Contract queries of table ingest, the registry and guarded SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once
from tabularium.functions.coercion import coerce, stored_type
from tabularium.functions.text import identifier
from tabularium.operators.ranking import top_k
from tabularium.operators.search import SearchOptions, hybrid_search
from tabularium.operators.sqlguard import (
    answer,
    audit,
    run_guarded,
    table_references,
)
from tabularium.operators.tables import (
    card_metadata,
    card_text,
    citation,
    default_description,
    delete_by_source,
    fit_cells,
    head_rows,
    infer_types,
    ingest_reply,
    label_map,
    lookup,
    name_tables,
    parse_description,
    register,
    schema_summary,
    typed_table,
)
from tabularium.plans.contract import contract, read
from tabularium.plans.retrieval import _ASKED, _EMBEDDINGS, _INDEX, _bm25, _dense, _fused, _reranked, questions
from tabularium.session import shared_path
from tabularium.sources.delimited import dispatch, read_delimited, unsupported
from tabularium.sources.tablestore import TableStore
from tabularium.sources.workbook import sheet_headers, workbook_rows

_SPACE = r"[ \x09-\x0D\x1C-\x1F\x85\p{Z}]+"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NULLS = "('', 'null', 'none', 'nan')"


def _stripped(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '^{_SPACE}', ''), '{_SPACE}$', '')"


# Names -----------------------------------------------------------------------


def _sql_identifier(name: str, prefix: str) -> str:
    safe = f"lower(trim(regexp_replace(regexp_replace({name}, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'))"
    return f"substr(CASE WHEN regexp_matches({safe}, '^([0-9]|$)') THEN '{prefix}_' || {safe} ELSE {safe} END, 1, 64)"


@contract(
    "sanitize_names",
    f"""WITH names AS (SELECT text AS name FROM conversations UNION ALL SELECT url FROM pages
                       UNION ALL SELECT p_type || ' ' || p_size FROM part UNION ALL SELECT p_size || '%' FROM part)
    SELECT name, {_sql_identifier("name", "t")} AS safe FROM names""",
)
def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    """Any text as a safe identifier: sentences, addresses, names, numbers."""
    part = read(spark, sf, "part")
    names = reduce(
        DataFrame.unionByName,
        [
            read(spark, sf, "conversations").select(F.col("text").alias("name")),
            read(spark, sf, "pages").select(F.col("url").alias("name")),
            part.select(F.concat("p_type", F.lit(" "), "p_size").alias("name")),
            part.select(F.concat("p_size", F.lit("%")).alias("name")),
        ],
    )
    return names.select("name", identifier(F.col("name")).alias("safe"))


def _incoming_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One table per document; all files of a language share their name, and
    labelled ones name a sheet."""
    documents = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return documents.select(
        F.md5(F.concat(F.lit("table "), "doc_id")).alias("table_id"),
        F.concat("source", F.lit("/Größe "), "lang", F.lit(".v1.csv")).alias("source_path"),
        F.md5("text").alias("file_hash"),
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("Q "), "quality")).alias("sheet_name"),
        F.col("n_chars").alias("row_count"),
        F.col("doc_id"),
    )


_TABLES = """
tables AS (
  SELECT md5('table ' || doc_id) AS table_id, source || '/Größe ' || lang || '.v1.csv' AS source_path,
         md5(text) AS file_hash, 'Q ' || quality AS sheet_name, n_chars AS row_count, doc_id,
         'gr_e_' || lang || '_v1' || coalesce('_q_' || quality, '') AS base
  FROM documents LEFT JOIN labels USING (doc_id)),
named AS (
  SELECT *, CASE WHEN base <> 'gr_e_fr_v1' AND table_id = min(table_id) OVER (PARTITION BY base) THEN base
                 ELSE base || '_' || substr(table_id, 1, 8) END AS table_name FROM tables)"""


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows of all tables, with a JSON column list."""
    held = read(spark, sf, "region").agg(F.md5(F.min("r_name")).alias("table_id")).select(
        F.lit("gr_e_fr_v1").alias("table_name"), "table_id"
    )
    named = name_tables(_incoming_tables(spark, sf), held)
    columns = F.array(
        F.struct(F.lit("doc_id").alias("name"), F.lit("INTEGER").alias("type"), F.lit("").alias("description")),
        F.struct(F.lit("text").alias("name"), F.lit("TEXT").alias("type"), F.lit("").alias("description")),
    )
    return named.select(
        "table_id",
        "table_name",
        "source_path",
        "file_hash",
        "sheet_name",
        default_description(F.col("source_path"), F.col("sheet_name")).alias("description"),
        F.to_json(columns).alias("columns_json"),
        "row_count",
    )


@contract("name_tables", f"WITH {_TABLES} SELECT table_id, table_name FROM named")
def named_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Table names with suffixes where a name is taken."""
    return _registry(spark, sf).select("table_id", "table_name")


# Typing and coercion ---------------------------------------------------------

_CELLS = """
cells AS (
  SELECT o_orderkey::VARCHAR AS order_key, o_orderstatus AS status, o_totalprice::VARCHAR AS price,
         strftime(o_orderdate, '%Y-%m-%d') AS ordered, CASE WHEN o_orderstatus = 'O' THEN 'ja' ELSE 'Nein' END AS open,
         ' ' || o_custkey || ' ' AS customer, CASE WHEN o_orderstatus = 'F' THEN 'NULL' END AS nothing,
         CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_custkey || '.5' END AS half, o_orderpriority AS priority FROM orders)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    closed = F.col("o_orderstatus") == "F"
    return orders.select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderdate").cast("date").cast("string").alias("ordered"),
        F.when(F.col("o_orderstatus") == "O", "ja").otherwise("Nein").alias("open"),
        F.concat(F.lit(" "), "o_custkey", F.lit(" ")).alias("customer"),
        F.when(closed, "NULL").alias("nothing"),
        F.when(closed, "none").otherwise(F.concat("o_custkey", F.lit(".5"))).alias("half"),
        F.col("o_orderpriority").alias("priority"),
    )


_CELL_COLUMNS = ("order_key", "status", "price", "ordered", "open", "customer", "nothing", "half", "priority")


def _typed_sql(position: int, column: str) -> str:
    clean = _stripped(column)
    filled = f"({column} IS NOT NULL AND lower({clean}) NOT IN {_NULLS})"
    return f"""SELECT {position} AS position, '{column}' AS "column", count(*) FILTER ({filled}) AS filled,
      CASE WHEN count(*) FILTER ({filled}) = 0 THEN 'TEXT'
           WHEN bool_and(lower({clean}) IN ('true','false','yes','no','ja','nein')) FILTER ({filled}) THEN 'BOOLEAN'
           WHEN bool_and(regexp_matches({clean}, '^[+-]?\\d+$') AND try_cast({clean} AS BIGINT) IS NOT NULL) FILTER ({filled}) THEN 'INTEGER'
           WHEN bool_and(regexp_matches({clean}, '{_DECIMAL}') AND try_cast({clean} AS DOUBLE) IS NOT NULL) FILTER ({filled}) THEN 'REAL'
           WHEN bool_and(regexp_matches({clean}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast({clean} AS DATE) IS NOT NULL) FILTER ({filled}) THEN 'DATE'
           ELSE 'TEXT' END AS type FROM cells"""


@contract("infer_types", f"WITH {_CELLS} " + " UNION ALL ".join(_typed_sql(i, c) for i, c in enumerate(_CELL_COLUMNS)))
def infer_column_types(spark: SparkSession, sf: str) -> DataFrame:
    """Type of every text column, from all of its cells."""
    inferred = infer_types(_cells(spark, sf), _CELL_COLUMNS)
    return inferred


@contract(
    "typed_table",
    f"""WITH {_CELLS} SELECT order_key::BIGINT AS order_key, status, price::DOUBLE AS price, ordered::DATE AS ordered,
    open = 'ja' AS open, trim(customer)::BIGINT AS customer, CASE WHEN nothing <> 'NULL' THEN nothing END AS nothing,
    try_cast(half AS DOUBLE) AS half, priority FROM cells""",
)
def typed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns as a typed table under their inferred types."""
    cells = _cells(spark, sf)
    return typed_table(cells, label_map(infer_types(cells))).drop("_rescued")


_DIRTY = """
dirty AS (
  SELECT event_id, CASE event_type
           WHEN 'click' THEN ' ' || value || ' ' WHEN 'view' THEN user_id::VARCHAR
           WHEN 'error' THEN CASE WHEN value < 5 THEN 'inf' WHEN value < 10 THEN '1d' WHEN value < 15 THEN '1e3'
                                  WHEN value < 20 THEN '1e30' WHEN value < 25 THEN '1,5' WHEN value < 30 THEN '9007199254740993'
                                  WHEN value < 35 THEN '-3.9' WHEN value < 40 THEN '2024-02-30' ELSE '2024-02-29' END
           WHEN 'purchase' THEN user_id || 'K'
           ELSE CASE WHEN value < 10 THEN 'None' WHEN value < 20 THEN '' WHEN value < 30 THEN 'JA' WHEN value < 40 THEN 'yes'
                     WHEN value < 50 THEN '1' ELSE props END END AS cell
  FROM events)"""


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    value, user = F.col("value"), F.col("user_id").cast("string")

    def steps(pairs: list[tuple[int, str]], last: Column) -> Column:
        for bound, text in reversed(pairs):
            last = F.when(value < bound, text).otherwise(last)
        return last

    errors = steps(
        [(5, "inf"), (10, "1d"), (15, "1e3"), (20, "1e30"), (25, "1,5"), (30, "9007199254740993"), (35, "-3.9"), (40, "2024-02-30")],
        F.lit("2024-02-29"),
    )
    words = steps([(10, "None"), (20, ""), (30, "JA"), (40, "yes"), (50, "1")], F.col("props"))
    kind = F.col("event_type")
    cell = (
        F.when(kind == "click", F.concat(F.lit(" "), value.cast("string"), F.lit(" ")))
        .when(kind == "view", user)
        .when(kind == "error", errors)
        .when(kind == "purchase", F.concat(user, F.lit("K")))
        .otherwise(words)
    )
    return read(spark, sf, "events").select("event_id", cell.alias("cell"))


def _coerced_sql() -> str:
    c = _stripped("cell")
    filled = f"(cell IS NOT NULL AND lower({c}) NOT IN {_NULLS})"
    number = f"CASE WHEN regexp_matches({c}, '{_DECIMAL}') THEN try_cast({c} AS DOUBLE) END"
    whole = f"CASE WHEN regexp_matches({c}, '^[+-]?\\d+$') THEN try_cast({c} AS BIGINT) END"
    suffixed = f"CASE WHEN regexp_matches({c}, '^\\d+K$') THEN try_cast(rtrim({c}, 'K') AS DOUBLE) * 1000 END"
    day = f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast({c} AS DATE) END"
    return f"""typed AS (SELECT event_id, cell, {filled} AS filled,
      CASE WHEN {filled} THEN coalesce({whole}, try_cast(trunc({number}) AS BIGINT)) END AS as_integer,
      CASE WHEN {filled} THEN {number} END AS as_real,
      CASE WHEN {filled} THEN lower({c}) IN ('true','1','yes','ja') END AS as_boolean,
      CASE WHEN {filled} THEN {day} END AS as_date,
      CASE WHEN {filled} THEN coalesce({number}, {suffixed}) END AS as_scaled FROM dirty)"""


@contract(
    "coerce_values",
    f"""WITH {_DIRTY}, {_coerced_sql()} SELECT event_id, as_integer, as_real, as_boolean, as_date, as_scaled,
    CASE WHEN filled AND as_integer IS NULL THEN cell END AS rescued_integer,
    CASE WHEN filled AND as_date IS NULL THEN cell END AS rescued_date FROM typed""",
)
def coerce_values(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty cells under every type; what does not fit is rescued."""
    dirty = _dirty(spark, sf)
    wide = dirty.select(
        "event_id", F.col("cell").alias("as_integer"), F.col("cell").alias("as_real"), F.col("cell").alias("as_boolean"),
        F.col("cell").alias("as_date"), "cell",
    )
    labels = {"as_integer": "INTEGER", "as_real": "REAL", "as_boolean": "BOOLEAN", "as_date": "DATE"}
    typed = typed_table(wide.withColumn("event_id", F.col("event_id").cast("string")), labels | {"event_id": "INTEGER"})
    return typed.select(
        "event_id",
        *labels,
        coerce(F.col("cell"), "REAL", magnitude_suffix=True).alias("as_scaled"),
        F.try_element_at("_rescued", F.lit("as_integer")).alias("rescued_integer"),
        F.try_element_at("_rescued", F.lit("as_date")).alias("rescued_date"),
    )


@contract(
    "type_labels",
    """SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'integer' WHEN 'Brand#2' THEN ' REAL ' WHEN 'Brand#3' THEN 'DATE'
      WHEN 'Brand#4' THEN 'Boolean' WHEN 'Brand#5' THEN 'NUMERIC' WHEN 'Brand#6' THEN 'TEXT' ELSE p_type END AS label,
      CASE p_brand WHEN 'Brand#1' THEN 'bigint' WHEN 'Brand#2' THEN 'double' WHEN 'Brand#3' THEN 'date'
      WHEN 'Brand#4' THEN 'boolean' WHEN 'Brand#5' THEN 'double' ELSE 'string' END AS stored FROM part""",
)
def type_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Stored type of column labels; labels nobody knows are text."""
    label = F.col("p_type")
    for brand, text in (
        ("Brand#1", "integer"), ("Brand#2", " REAL "), ("Brand#3", "DATE"),
        ("Brand#4", "Boolean"), ("Brand#5", "NUMERIC"), ("Brand#6", "TEXT"),
    ):
        label = F.when(F.col("p_brand") == brand, text).otherwise(label)
    return read(spark, sf, "part").select("p_partkey", label.alias("label")).withColumn("stored", stored_type(F.col("label")))


@contract(
    "fit_rows",
    """WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents)
    SELECT doc_id, c[1] AS c0, c[2] AS c1, c[3] AS c2, c[4] AS c3 FROM cut""",
)
def fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of any length padded or cut to a header of four columns."""
    documents = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("cells"))
    return documents.select("doc_id", *[c.alias(f"c{i}") for i, c in enumerate(fit_cells(F.col("cells"), 4))])


# Files -----------------------------------------------------------------------


@contract("csv_scan", "SELECT doc_id, lang, source, md5(text) AS text_md5, n_chars FROM documents")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as CSV, with line breaks and quotes, and read back typed."""
    path = shared_path(spark, "csv")
    documents = read(spark, sf, "documents")
    documents.select("doc_id", "lang", "source", "text", "n_chars").write.options(
        header="true", escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)
    cells = read_delimited(spark, path)
    typed = typed_table(cells, label_map(infer_types(cells)))
    return typed.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), "n_chars")


@contract("tsv_scan", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def tsv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as TSV and read back typed."""
    path = shared_path(spark, "tsv")
    read(spark, sf, "customer").write.options(header="true", sep="\t").csv(path)
    cells = read_delimited(spark, path, "\t")
    return typed_table(cells, label_map(infer_types(cells))).drop("_rescued")


@contract(
    "file_dispatch",
    """WITH files AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.CSV' WHEN 'fr' THEN '.tsv'
      WHEN 'de' THEN '.xlsx' ELSE '.json' END AS path, lang FROM documents)
    SELECT path, CASE lang WHEN 'en' THEN 'delimited' WHEN 'fr' THEN 'delimited' WHEN 'de' THEN 'workbook'
      ELSE 'Unsupported table file format: .json' END AS reader FROM files""",
)
def file_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Reader of every file by extension; others become failure records."""
    extension = F.when(F.col("lang") == "en", ".CSV").when(F.col("lang") == "fr", ".tsv").when(F.col("lang") == "de", ".xlsx").otherwise(".json")
    files = read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id", extension).alias("path"))
    readable = files.select("path", dispatch(F.col("path")).alias("reader")).filter(F.col("reader").isNotNull())
    return readable.unionByName(unsupported(files).withColumnRenamed("error", "reader"))


def _line_sheets(content: bytes):
    """A stand-in sheet reader: one sheet, lines as rows, words parted by ' | '."""
    lines = content.decode().split("\n")
    if len(lines) > 1:
        yield "Sheet1", [line.split(" | ") for line in lines]


@contract(
    "workbook_scan",
    """WITH ln AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(text, chr(10))) AS line,
                          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row_no
                   FROM documents WHERE contains(text, chr(10)))
    SELECT path, 'Sheet1' AS sheet, row_no::INT AS row_no, len(string_split(line, ' | '))::INT AS width,
           string_split(line, ' | ')[1] AS first_cell FROM ln""",
)
def workbook_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Workbook rows through a sheet reader; files without data rows are skipped."""
    files = read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")
    )
    rows = workbook_rows(files, _line_sheets)
    return rows.select("path", "sheet", "row_no", F.size("cells").alias("width"), F.get("cells", F.lit(0)).alias("first_cell"))


@contract(
    "workbook_headers",
    """SELECT doc_id::VARCHAR AS path, 'Sheet1' AS sheet, string_split(text, chr(10))[1] AS headers
    FROM documents WHERE contains(text, chr(10))""",
)
def workbook_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header row of every sheet."""
    files = read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")
    )
    headers = sheet_headers(workbook_rows(files, _line_sheets))
    return headers.withColumn("headers", F.array_join("headers", " | "))


# Registry --------------------------------------------------------------------


@contract(
    "registry_upsert",
    f"""WITH {_TABLES}, bumped AS (SELECT n.table_id, 'v2 ' || table_name AS table_name, n.row_count + 1 AS row_count
                                   FROM named n JOIN labels l USING (doc_id) WHERE l.quality = 1)
    SELECT table_id, table_name, row_count FROM bumped
    UNION ALL SELECT table_id, table_name, row_count FROM named WHERE table_id NOT IN (SELECT table_id FROM bumped)""",
)
def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Registry after tables of good documents were ingested again."""
    registry = _registry(spark, sf)
    good = read(spark, sf, "labels").filter(F.col("quality") == 1)
    again = good.select(F.md5(F.concat(F.lit("table "), "doc_id")).alias("table_id"))
    entries = registry.join(again, "table_id", "left_semi").withColumns(
        {"table_name": F.concat(F.lit("v2 "), "table_name"), "row_count": F.col("row_count") + 1}
    )
    return register(registry, entries, [F.asc("table_name")]).select("table_id", "table_name", "row_count")


@contract(
    "registry_lookup",
    f"""WITH {_TABLES}, wanted AS (SELECT doc_id AS position, md5('table ' || doc_id) AS table_id FROM labels
                                   UNION ALL SELECT -page_id - 1, md5(url) FROM pages)
    SELECT w.position, w.table_id, n.table_name, 2 AS columns, 'doc_id' AS first_column, 'INTEGER' AS first_type
    FROM wanted w JOIN named n USING (table_id)""",
)
def registry_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Tables by id in the order asked for; unknown ids are skipped."""
    known = read(spark, sf, "labels").select(
        F.col("doc_id").alias("position"), F.md5(F.concat(F.lit("table "), "doc_id")).alias("table_id")
    )
    strange = read(spark, sf, "pages").select((-F.col("page_id") - 1).alias("position"), F.md5("url").alias("table_id"))
    found = lookup(_registry(spark, sf), known.unionByName(strange))
    return found.select(
        "position", "table_id", "table_name", F.size("columns").alias("columns"),
        F.col("columns")[0]["name"].alias("first_column"), F.col("columns")[0]["type"].alias("first_type"),
    )


@contract(
    "registry_delete",
    f"""WITH {_TABLES} SELECT table_id, table_name, source_path NOT LIKE 'src1/%' AS kept FROM named""",
)
def registry_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that go with the files of one source, and those that stay."""
    registry = _registry(spark, sf)
    sources = registry.filter(F.col("source_path").startswith("src1/")).select("source_path")
    kept, gone = delete_by_source(registry, sources)
    return kept.select("table_id", "table_name", F.lit(True).alias("kept")).unionByName(
        gone.withColumn("kept", F.lit(False))
    )


@contract(
    "table_citations",
    f"""WITH {_TABLES} SELECT table_id, '[Quelle: ' || source_path || coalesce(', Sheet: ' || sheet_name, '') || ', Tabelle: '
    || table_name || ']' AS citation FROM named""",
)
def table_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citation of every registered table."""
    cited = citation(F.col("source_path"), F.col("sheet_name"), F.col("table_name"))
    return _registry(spark, sf).select("table_id", cited.alias("citation"))


@contract(
    "schema_summary",
    f"""WITH {_TABLES} SELECT table_id, 'Table "' || table_name || '": Table from ' || string_split(source_path, '/')[2]
    || coalesce(', sheet ''' || sheet_name || '''', '') || chr(10) || '  Columns: doc_id (INTEGER), text (TEXT)  — '
    || row_count || ' rows' AS summary FROM named""",
)
def schema_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Schema text of every registered table."""
    registry = _registry(spark, sf)
    columns = F.from_json("columns_json", "array<struct<name:string,type:string,description:string>>")
    summary = schema_summary(F.col("table_name"), F.col("description"), columns, F.col("row_count"))
    return registry.select("table_id", summary.alias("summary"))


@contract(
    "card_metadata",
    f"""WITH {_TABLES} SELECT table_id, table_name, source_path AS source, string_split(source_path, '/')[2] AS "fileName",
    file_hash AS "fileHash", sheet_name AS "sheetName", 'table' AS "contentType", '["doc_id","text"]' AS columns,
    row_count::VARCHAR AS "rowCount" FROM named""",
)
def card_metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of every table's card."""
    registry = _registry(spark, sf).withColumn(
        "columns", F.from_json("columns_json", "array<struct<name:string,type:string,description:string>>")
    )
    meta = registry.select(card_metadata(registry).alias("m"))
    keys = ("table_id", "table_name", "source", "fileName", "fileHash", "sheetName", "contentType", "columns", "rowCount")
    return meta.select(*[F.col("m")[key].alias(key) for key in keys])


@contract(
    "ingest_reply",
    f"WITH {_TABLES} SELECT count(*) AS total_tables, sum(row_count)::BIGINT AS total_rows, 2 * count(*) AS total_columns FROM named",
)
def ingest_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals an ingest reports."""
    columns = F.from_json("columns_json", "array<struct<name:string,type:string,description:string>>")
    return ingest_reply(_registry(spark, sf).withColumn("columns", columns))


# Cards -----------------------------------------------------------------------

# Tables shown as cards, with the columns that order their rows.
_CARDS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "documents": ("doc_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
    "events": ("event_id",),
    "embeddings": ("vec_id",),
}
_CARD_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
    "events": "event_id ts user_id event_type value props",
    "embeddings": "vec_id embedding label",
}


def _card_sql(table: str) -> str:
    columns = _CARD_COLUMNS[table].split()
    cells = [f"{c}::DECIMAL(9, 6)[]" if c == "embedding" else c for c in columns]
    row = " || ' | ' || ".join(f"coalesce({c}::VARCHAR, '')" for c in cells)
    order = ", ".join(_CARDS[table])
    return f"""(SELECT '{table}' AS table_name, 'Table from {table}.csv' || chr(10) || chr(10) || 'Columns: {', '.join(columns)}'
      || chr(10) || chr(10) || 'Sample data:' || chr(10) || '{' | '.join(columns)}' || chr(10)
      || (SELECT string_agg(r || chr(10), '' ORDER BY k) FROM (
            SELECT {row} AS r, row_number() OVER (ORDER BY {order}) AS k FROM {table} QUALIFY k <= 2)) AS card,
      (SELECT count(*) FROM {table}) AS row_count)"""


@contract("table_cards", " UNION ALL ".join(_card_sql(t) for t in _CARDS))
def table_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Card and row count of the tables of the schema."""

    def card(table: str) -> DataFrame:
        rows = read(spark, sf, table)
        if table == "embeddings":
            # Six digits: the two engines spell short floats differently.
            rows = rows.withColumn("embedding", F.col("embedding").cast("array<decimal(9,6)>"))
        columns = _CARD_COLUMNS[table].split()
        headers = F.array(*[F.lit(c) for c in columns])
        sample = head_rows(rows, [F.col(c) for c in _CARDS[table]], columns)
        counted = rows.agg(F.count("*").alias("row_count"))
        text = card_text(F.lit(f"Table from {table}.csv"), headers, F.col("sample_rows"))
        one = F.lit(table).alias("table_name")
        return sample.select(one, text.alias("card")).join(counted.select(one, "row_count"), "table_name")

    return reduce(DataFrame.unionByName, [card(table) for table in _CARDS])


def _source_cards(spark: SparkSession, sf: str) -> DataFrame:
    """One card per source and language, as if each were a table of documents."""
    documents = read(spark, sf, "documents").select("source", "lang", "doc_id", "text")
    first = top_k(documents, ["source", "lang"], [F.asc("doc_id")], 2)
    line = F.array(F.col("doc_id").cast("string"), F.col("text"))
    grouped = first.groupBy("source", "lang").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("cells")))).alias("s"))
    path = F.concat("source", F.lit("/"), "lang", F.lit(".csv"))
    headers = F.array(F.lit("doc_id"), F.lit("text"))
    text = card_text(default_description(path, F.lit(None).cast("string")), headers, F.transform("s", lambda r: r["cells"]))
    return grouped.select(path.alias("id"), text.alias("text"))


@contract(
    "table_retrieval",
    f"""WITH raw AS (SELECT * FROM documents),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM raw QUALIFY k <= 2),
    documents AS (
      SELECT source || '/' || lang || '.csv' AS doc_id, 'Table from ' || lang || '.csv' || chr(10) || chr(10)
             || 'Columns: doc_id, text' || chr(10) || chr(10) || 'Sample data:' || chr(10) || 'doc_id | text' || chr(10)
             || string_agg(doc_id || ' | ' || text || chr(10), '' ORDER BY k) AS text
      FROM firsts GROUP BY source, lang),
    {_INDEX}, {_bm25(_ASKED, 80)}, {_EMBEDDINGS}, {_dense(80)}, {_fused(40)}, {_reranked("fused", 8)}
    SELECT query_id, id, score, rank::INT AS rank FROM reranked""",
)
def table_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best tables per question, found by their cards."""
    found = hybrid_search(_source_cards(spark, sf), questions(spark, sf), SearchOptions(limit=8, rerank=True))
    return found.select("query_id", "id", "score", "rank")


@contract(
    "describe_reply",
    """SELECT event_id,
      CASE WHEN event_type = 'error' THEN 'Table from e.csv' WHEN event_type = 'view' THEN 'Table from e.csv' ELSE event_type END AS description,
      CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' THEN 0 ELSE 1 END AS columns,
      CASE WHEN event_type = 'error' THEN 'malformed reply' END AS error FROM events""",
)
def describe_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Describer replies as JSON: whole, partial and broken ones."""
    kind = F.col("event_type")
    whole = F.concat(F.lit('{"description":"'), kind, F.lit('","columns":[{"name":"k","type":"INTEGER","description":""}]}'))
    reply = F.when(kind == "error", F.concat(F.lit("Sure: "), "props")).when(kind == "view", F.col("props")).otherwise(whole)
    parsed = parse_description(reply, F.lit("Table from e.csv"), F.array(F.lit("k"), F.lit("v")))
    events = read(spark, sf, "events").select("event_id", parsed.alias("p"))
    return events.select("event_id", "p.description", F.size("p.columns").alias("columns"), "p.error")


# Guarded SQL -----------------------------------------------------------------

# Statement shapes; {u} is a user number, {t} an event type that names a table.
# Statement, the tables it reads, and the guard's verdict, all worked out by hand: the SQL below knows no rule of the guard.
_SHAPES = (
    ("SELECT * FROM {t}", "{t}", None),
    ("  select a, b from {t} where c = {u} ;; ", "{t}", None),
    ("SELECT * FROM {t}; DROP TABLE {t}", "{t}", "multiple statements"),
    ("; ;", "", "multiple statements"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "x", "not a SELECT"),
    ("DELETE FROM {t} WHERE id = {u}", "", "not a SELECT"),
    ("SELECT ''please delete'' AS note FROM {t}", "{t}", "forbidden keyword"),
    ("SELECT created_at FROM {t} WHERE updated_by = {u}", "{t}", None),
    ("SELECT REPLACE(a, ''x'', ''y'') FROM {t}", "{t}", "forbidden keyword"),
    ("SELECT * FROM sqlite_master", "sqlite_master", "internal table"),
    ("SELECT * FROM _table_registry JOIN {t} ON 1 = 1", "_table_registry,{t}", "internal table"),
    ("SELECT * FROM {t} JOIN table_{u} USING (id) join other_{t} o ON o.id = 1", "{t},other_{t},table_{u}", "unknown tables: other_{t}, table_{u}"),
    ("SELECT ''from nowhere'' FROM \"{t}\" JOIN `click` ON 1 = 1", "click,{t}", None),
    ("SELECT EXTRACT(year FROM ts), ts IS DISTINCT FROM x FROM {t}", "{t}", None),
    ("SELECT reflect(''java.lang.System'', ''exit'') FROM {t}", "{t}", "forbidden function"),
    ("SELECT * FROM {t} a, secret b LIMIT 5", "{t},secret", "unknown tables: secret"),
    ("SELECT TRANSFORM(a) USING ''tr a b'' AS (x string) FROM {t}", "{t}", "script transformation"),
    ("SELECT a -- FROM nothing, other\nFROM {t} /* JOIN hidden */ WHERE b > {u}", "{t}", None),
    ("SELECT f(a, b) FROM (SELECT a, b FROM {t} x, (click y JOIN table_{u} z ON y.a = coalesce(z.a, 1))) q, global_temp.secret", "click,global_temp.secret,table_{u},{t}", "unknown tables: global_temp.secret, table_{u}"),
    ("SELECT a FROM {t} WHERE a IN (SELECT b, c FROM hidden_{u}) UNION ALL SELECT d, e FROM {t} ORDER BY d, e", "hidden_{u},{t}", "unknown tables: hidden_{u}"),
)


def _by_shape(column: int) -> str:
    """One text of every event's shape, as SQL."""
    def filled(text: str | None) -> str:
        return "NULL" if text is None else f"replace(replace('{text}', '{{t}}', event_type), '{{u}}', user_id::VARCHAR)"

    return f"CASE event_id % {len(_SHAPES)} {' '.join(f'WHEN {i} THEN {filled(shape[column])}' for i, shape in enumerate(_SHAPES))} END"


_STATEMENT_SQL = f"""told AS (SELECT event_id AS stmt_id, {_by_shape(0)} AS sql, {_by_shape(2)} AS reject_reason,
      array_to_string(list_sort(list_distinct(list_filter(string_split({_by_shape(1)}, ','), lambda x: x <> ''))), ',') AS refs FROM events)"""


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    """A statement for every event; the event number chooses its shape."""
    shape = F.array(*[F.lit(s.replace("''", "'")) for s, _, _ in _SHAPES])[(F.col("event_id") % len(_SHAPES)).cast("int")]
    sql = F.replace(F.replace(shape, F.lit("{t}"), F.col("event_type")), F.lit("{u}"), F.col("user_id").cast("string"))
    return read(spark, sf, "events").select(F.col("event_id").alias("stmt_id"), sql.alias("sql"))


@contract(
    "sql_audit",
    f"""WITH {_STATEMENT_SQL} SELECT stmt_id, regexp_replace({_stripped("sql")}, ';+$', '') AS cleaned_sql, refs, reject_reason FROM told""",
)
def sql_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of the guard on every statement."""
    known = read(spark, sf, "events").select(F.col("event_type").alias("table_name")).distinct()
    judged = audit(_statements(spark, sf), known)
    return judged.select("stmt_id", "cleaned_sql", F.array_join("refs", ",").alias("refs"), "reject_reason")


@contract(
    "sql_refs",
    f"""WITH {_STATEMENT_SQL} SELECT name, count(*) AS statements FROM (SELECT unnest(string_split(refs, ',')) AS name FROM told WHERE refs <> '')
    GROUP BY name""",
)
def sql_refs(spark: SparkSession, sf: str) -> DataFrame:
    """How many statements read each table."""
    named = explode_once(_statements(spark, sf), table_references(F.col("sql")), "name")
    return named.groupBy("name").agg(F.count("*").alias("statements"))


_REPORT = """SELECT l_returnflag, l_linestatus, l_shipdate, sum(l_quantity) AS quantity, count(*) AS items
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_shipdate ORDER BY l_shipdate, l_returnflag, l_linestatus"""


@contract("sql_run_capped", f"{_REPORT} LIMIT 200")
def sql_run_capped(spark: SparkSession, sf: str) -> DataFrame:
    """A guarded statement, cut at 200 rows."""
    return run_guarded(spark, _REPORT + " ;", {"lineitem": f"{sf}/lineitem.parquet"}, max_rows=200)


_QUESTION = """SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY n_name"""


@contract(
    "sql_ask",
    f"""WITH rows AS ({_QUESTION})
    SELECT 'ok' AS status, string_agg('{{"n_name":"' || n_name || '","customers":' || customers || '}}', chr(10) ORDER BY n_name) AS rows,
           count(*)::INT AS row_count, false AS truncated, 'n_name,customers' AS columns, 'nation,customer' AS tables,
           '[Quelle: tpch/nation.csv, Tabelle: nation] [Quelle: tpch/customer.csv, Sheet: C, Tabelle: customer]' AS citations
    FROM rows""",
)
def sql_ask(spark: SparkSession, sf: str) -> DataFrame:
    """Answer package of a statement over two registered tables."""
    names = {"nation": None, "customer": "C"}
    registry = reduce(
        DataFrame.unionByName,
        [
            read(spark, sf, name).agg(F.count("*").alias("row_count")).select(
                F.md5(F.lit(name)).alias("table_id"), F.lit(name).alias("table_name"),
                F.lit(f"tpch/{name}.csv").alias("source_path"), F.lit(sheet).cast("string").alias("sheet_name"),
                F.lit("[]").alias("columns_json"), "row_count",
            )
            for name, sheet in names.items()
        ],
    )
    wanted = registry.select("table_id", F.when(F.col("table_name") == "nation", 0).otherwise(1).alias("position"))
    package = answer(spark, _QUESTION, lookup(registry, wanted), {name: f"{sf}/{name}.parquet" for name in names})
    return package.select(
        "status", F.array_join("rows", "\n").alias("rows"), "row_count", "truncated",
        F.array_join(F.transform("tables", lambda t: t["table_name"]), ",").alias("tables"),
        F.array_join("columns", ",").alias("columns"), F.array_join("citations", " ").alias("citations"),
    )


@contract(
    "table_ingest",
    """SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS row_count, 6 AS column_count, c_mktsegment, count(*) AS customers,
    sum(c_acctbal::DECIMAL(18, 2))::DOUBLE AS balance, min(c_custkey) AS first_key FROM customer GROUP BY c_mktsegment""",
)
def table_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file stored, registered and queried by its id through the guard."""
    path = shared_path(spark, "csv")
    customers = read(spark, sf, "customer").withColumn("since", F.lit("2024-02-29"))
    customers.write.option("header", "true").csv(path)
    store = TableStore(spark, shared_path(spark, "tables"))
    reply = store.ingest(path, "tpch/customer.csv", "h1").first()
    schemas = store.schemas([reply["table_id"], "nobody"])
    rows = run_guarded(
        spark,
        """SELECT c_mktsegment, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance,
        min(c_custkey) AS first_key FROM customer WHERE since = DATE '2024-02-29' GROUP BY c_mktsegment""",
        store.readers(schemas),
    )
    return rows.select(
        F.lit(reply["table_name"]).alias("table_name"), F.lit(reply["row_count"]).alias("row_count"),
        F.lit(reply["column_count"]).alias("column_count"), "*",
    )
