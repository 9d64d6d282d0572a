"""Structural chunking: blocks to chunks under a token budget.

Everything stays inside the row: documents are spread over tasks by the scan,
and no shuffle is needed to cut them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once, grown
from tabularium.functions.text import SPACE, file_name, words

# Tokens per chunk; a token is a white-space separated word.
TOKEN_BUDGET = 512

_SENTENCE_END = r"([.!?])" + SPACE


def _sized(text: Column) -> Column:
    return F.struct(text.alias("text"), F.size(words(text)).alias("size"))


def _windows(sentence: Column, size: Column, budget: int) -> Column:
    parts = words(sentence)
    return F.transform(
        F.sequence(F.lit(0), F.ceil(size / budget).cast("int") - 1),
        lambda i: F.struct(
            F.array_join(F.slice(parts, i * budget + 1, budget), " ").alias("text"),
            F.least(F.lit(budget), size - i * budget).alias("size"),
        ),
    )


def pieces(block: Column, budget: int) -> Column:
    """``(text, size)`` of a sized block as it is, or, above the budget, of its
    sentences; a sentence above the budget is cut in windows of whole words."""
    sentences = F.transform(F.split(F.regexp_replace(block["text"], _SENTENCE_END, "$1\x01"), "\x01"), _sized)
    cut = F.flatten(
        F.transform(
            F.filter(sentences, lambda s: s["size"] > 0),
            lambda s: F.when(s["size"] <= budget, F.array(s)).otherwise(_windows(s["text"], s["size"], budget)),
        )
    )
    whole = F.array(F.struct(block["text"].alias("text"), block["size"].alias("size")))
    return F.when(block["size"] <= budget, whole).otherwise(cut)


def chunk_starts(parts: Column, budget: int) -> Column:
    """1-based positions of the pieces that open a chunk.

    A piece opens one when its headings differ from those before it or when it
    would push the chunk over the budget. The fold keeps positions only.
    """
    empty = F.struct(
        F.array().cast("array<array<int>>").alias("full"),
        F.array().cast("array<int>").alias("starts"),
        F.lit(0).alias("fill"),
        F.lit(None).cast("array<string>").alias("headings"),
    )
    numbered = F.transform(
        parts,
        lambda p, i: F.struct((i + 1).alias("place"), p["size"].alias("size"), p["headings"].alias("headings")),
    )

    def step(state: Column, piece: Column) -> Column:
        opens = (
            (F.size(state["starts"]) + F.size(state["full"]) == 0)
            | ~state["headings"].eqNullSafe(piece["headings"])
            | (state["fill"] + piece["size"] > budget)
        )
        full, starts = grown(state["full"], state["starts"], piece["place"])
        return F.struct(
            F.when(opens, full).otherwise(state["full"]).alias("full"),
            F.when(opens, starts).otherwise(state["starts"]).alias("starts"),
            F.when(opens, piece["size"]).otherwise(state["fill"] + piece["size"]).alias("fill"),
            piece["headings"].alias("headings"),
        )

    return F.aggregate(numbered, empty, step, lambda state: F.concat(F.flatten(state["full"]), state["starts"]))


def nonempty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def chunk(
    documents: DataFrame,
    budget: int = TOKEN_BUDGET,
    include_raw_text: bool = False,
    path_col: str = "path",
    blocks_col: str = "blocks",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Cut ``(path, blocks)`` in chunks, numbered from 0 within each path.

    Columns named in ``carry`` go along with every chunk.

    ``text`` is the chunk with its headings in front; ``raw_text`` the bare chunk,
    on request. Empty heading and page lists are null.
    """
    sized = F.transform(blocks_col, lambda b, i: F.struct(b.alias("own"), _sized(b["text"]).alias("sized"), i.alias("no")))
    numbered = F.flatten(
        F.transform(
            sized,
            lambda block: F.transform(
                pieces(block["sized"], budget),
                lambda piece: F.struct(
                    piece["text"].alias("text"),
                    piece["size"].alias("size"),
                    block["own"]["headings"].alias("headings"),
                    block["own"]["page"].alias("page"),
                    block["no"].alias("block"),
                ),
            ),
        )
    )
    cut = documents.select(F.col(path_col).alias("path"), *carry, numbered.alias("_parts"))
    cut = cut.withColumn("_starts", chunk_starts(F.col("_parts"), budget))
    # Each chunk takes its own pieces along, not those of the whole document.
    owned = F.transform(
        "_starts",
        lambda start, i: F.slice("_parts", start, F.coalesce(F.get("_starts", i + 1), F.size("_parts") + 1) - start),
    )
    cut = explode_once(cut.select("path", *carry, owned.alias("_chunks")), F.col("_chunks"), "_own", "chunk_index")
    body = F.array_join(F.transform("_own", lambda p: p["text"]), "\n")
    headings = F.col("_own")[0]["headings"]
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("_own", lambda p: p["page"]), F.isnotnull)))
    refs = F.array_distinct(
        F.transform("_own", lambda p: F.concat(F.lit("#/texts/"), p["block"].cast("string")))
    )
    return cut.select("path", *carry, "chunk_index", "_own").select(
        "path",
        *carry,
        file_name(F.col("path")).alias("filename"),
        "chunk_index",
        F.concat_ws("\n", headings, body).alias("text"),
        (body if include_raw_text else F.lit(None).cast("string")).alias("raw_text"),
        F.aggregate("_own", F.lit(0), lambda total, p: total + p["size"]).alias("num_tokens"),
        nonempty(headings).alias("headings"),
        F.lit(None).cast("array<string>").alias("captions"),
        refs.alias("doc_items"),
        nonempty(pages).alias("page_numbers"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def export_documents(documents: DataFrame, path_col: str = "path", blocks_col: str = "blocks") -> DataFrame:
    """Converted documents as nested JSON, one row per path.

    An ``errors`` column, if present, holds what the parser reported; a document
    without errors has the status ``success``.
    """
    error_type = "array<struct<component_type:string,module_name:string,error_message:string>>"
    errors = F.col("errors") if "errors" in documents.columns else F.array().cast(error_type)
    missing = F.lit(None).cast("string")
    content = F.struct(
        file_name(F.col(path_col)).alias("filename"),
        missing.alias("md_content"),
        F.to_json(F.struct(F.col(blocks_col).alias("texts"))).alias("json_content"),
        missing.alias("html_content"),
        missing.alias("text_content"),
        missing.alias("doctags_content"),
    )
    return documents.select(
        F.col(path_col).alias("path"),
        F.lit("ExportResult").alias("kind"),
        content.alias("content"),
        F.when(F.size(errors) > 0, "failure").otherwise("success").alias("status"),
        errors.alias("errors"),
        F.create_map().cast("map<string,double>").alias("timings"),
    )
