"""Registry of this subpackage's queries, and helpers that they share."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("suffix_runs", "url_rules", "packing", "bagminhash", "multiset_hash", "suffix_trees", "reply_trees", "licenses", "toxicity", "simhash", "vector_codes", "backoff_lm", "prefix_trie")


def contract(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and SQL of the subpackage."""
    for name in _MODULES:
        import_module(f"tabularium.llm.{name}")
    return dict(QUERIES), dict(ORACLES)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*columns: Column) -> Column:
    """Tells rows with one id but different texts apart; nulls count as values.

    Rows that are equal in all columns share a key, so what is worked out per
    key holds for each of them.
    """
    parts = [part for column in columns for part in (column.isNull(), column)]
    return F.xxhash64(*parts)
