"""Document files: bytes with their hash, parsed to ordered blocks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.markup import BLOCK_TYPE, html_blocks, text_blocks
from tabularium.functions.text import file_extension

# Extensions the built-in parsers read.
HTML = (".html", ".htm", ".xhtml")
PLAIN = (".txt", ".md", ".text")

ERROR_TYPE = "array<struct<component_type:string,module_name:string,error_message:string>>"

# bytes, path -> [(headings, text, page), ...]
Parser = Callable[[bytes, str], list[tuple[list[str], str, int | None]]]


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, file_hash, file_size, content, modified_at`` of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.md5("content").alias("file_hash"), F.col("length").alias("file_size"), "content", F.col("modificationTime").alias("modified_at")
    )


def parse_documents(files: DataFrame, parser: Parser | None = None) -> DataFrame:
    """``path, file_hash, file_size, blocks, errors``, in one pass over the files.

    HTML and plain text are parsed by built-in expressions. Other formats go to
    the ``parser`` plug-in, in Arrow batches; without one, or when it raises, the
    file gets an error record and the job goes on.
    """
    extension = file_extension(F.col("path"))
    is_html, is_plain = extension.isin(*HTML), extension.isin(*PLAIN)
    text = F.decode("content", "UTF-8")
    if parser is None:
        missing = F.struct(
            F.lit("document_backend").alias("component_type"),
            F.lit("parse_documents").alias("module_name"),
            F.concat(F.lit("no parser for "), extension).alias("error_message"),
        )
        other = F.struct(F.array().cast(BLOCK_TYPE).alias("blocks"), F.array(missing).alias("errors"))
    else:
        # Python sees the bytes of other formats only.
        other = _plug_in(parser)(F.when(~(is_html | is_plain), F.col("content")), F.col("path"))
    parsed = files.withColumn("_other", other)
    return parsed.select(
        "path",
        "file_hash",
        "file_size",
        F.when(is_html, html_blocks(text)).when(is_plain, text_blocks(text)).otherwise(F.col("_other.blocks")).alias("blocks"),
        F.when(is_html | is_plain, F.array().cast(ERROR_TYPE)).otherwise(F.col("_other.errors")).alias("errors"),
    )


def _plug_in(parser: Parser):
    block = pa.struct([("headings", pa.list_(pa.string())), ("text", pa.string()), ("page", pa.int32())])
    error = pa.struct([(name, pa.string()) for name in ("component_type", "module_name", "error_message")])
    result = pa.struct([("blocks", pa.list_(block)), ("errors", pa.list_(error))])

    @F.arrow_udf(f"struct<blocks:{BLOCK_TYPE},errors:{ERROR_TYPE}>")
    def parse(contents: pa.Array, paths: pa.Array) -> pa.Array:
        rows = []
        for content, path in zip(contents, paths.to_pylist(), strict=True):
            row = {"blocks": [], "errors": []}
            if content.is_valid:
                try:
                    row["blocks"] = [{"headings": h, "text": t, "page": p} for h, t, p in parser(content.as_py(), path)]
                except Exception as problem:  # noqa: BLE001 - a parser failure is a record, not a job failure
                    kind = type(problem).__name__
                    row["errors"] = [
                        {"component_type": "document_backend", "module_name": kind, "error_message": str(problem)}
                    ]
            rows.append(row)
        return pa.array(rows, result)

    return parse
