"""Context assembly: ranked hits to one cited text per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_citation(source: Column, page: Column) -> Column:
    """``[Quelle: path, Seite: n]``; the page only where there is one."""
    part = F.when(page.isNotNull(), F.concat(F.lit(", Seite: "), page.cast("string")))
    return F.concat(F.lit("[Quelle: "), source, F.coalesce(part, F.lit("")), F.lit("]"))


def assemble(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``query_id, context, citations, hit_count`` from ``(query_id, rank, text, citation)``.

    Hits have been cut to a limit per question, which bounds the collected group.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "citation")))
    grouped = hits.groupBy("query_id").agg(ordered.alias("_hits"))
    passages = F.transform("_hits", lambda h: F.concat(h["text"], F.lit("\n"), h["citation"]))
    return grouped.select(
        "query_id",
        F.array_join(passages, separator).alias("context"),
        F.array_distinct(F.transform("_hits", lambda h: h["citation"])).alias("citations"),
        F.size("_hits").alias("hit_count"),
    )
