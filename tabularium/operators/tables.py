"""Typed tables, their registry, and the cards that make them searchable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.coercion import clean_cell, coerce_clean, rescued, type_evidence, type_from_evidence
from tabularium.functions.text import file_name, file_stem, identifier
from tabularium.operators.upsert import keyed_upsert

RESCUED = "_rescued"
# Rows shown on a table card.
CARD_ROWS = 2


def infer_types(cells: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``position, column, type, filled`` for text columns, from all their cells.

    One pass and one row of counts, however many columns there are.
    """
    columns = list(columns or cells.columns)
    # Cells are cleaned in a step of their own, so that five counts share one cleaning.
    cleaned = cells.select(*[clean_cell(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    counted = cleaned.agg(*[F.struct(*type_evidence(F.col(f"c{i}"))).alias(f"c{i}") for i in range(len(columns))])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                type_from_evidence(F.col(f"c{i}")).alias("type"),
                F.col(f"c{i}.filled").alias("filled"),
            )
            for i, name in enumerate(columns)
        ]
    )
    return counted.select(F.inline(rows))


def label_map(inferred: DataFrame) -> dict[str, str]:
    """Column labels on the driver: one entry per column of one table."""
    return {row["column"]: row["type"] for row in inferred.select("column", "type").toLocalIterator()}


def typed_table(cells: DataFrame, labels: Mapping[str, str], magnitude_suffix: bool = False) -> DataFrame:
    """Text columns as typed columns plus ``_rescued``; unlabelled ones stay text."""
    names = cells.columns
    checked = [name for name in names if labels.get(name, "TEXT") != "TEXT"]
    # Cleaning, typing and rescuing are steps of their own: each result is used
    # more than once, and Catalyst keeps such steps apart.
    cleaned = cells.select(
        *[F.col(f"`{n}`").alias(f"r{i}") for i, n in enumerate(names)],
        *[clean_cell(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)],
    )
    typed = cleaned.select(
        "*",
        *[
            coerce_clean(F.col(f"c{i}"), F.col(f"r{i}"), labels.get(n, "TEXT"), magnitude_suffix).alias(f"t{i}")
            for i, n in enumerate(names)
        ],
    )
    forms = {n: (F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"t{i}")) for i, n in enumerate(names) if n in checked}
    spare = rescued(forms) if forms else F.lit(None).cast("map<string,string>")
    return typed.select(*[F.col(f"t{i}").alias(n) for i, n in enumerate(names)], spare.alias(RESCUED))


def fit_cells(cells: Column, width: int) -> list[Column]:
    """A row of any length as exactly ``width`` cells: padded with null or cut."""
    return [F.get(cells, F.lit(i)) for i in range(width)]


def base_name(source_path: Column, sheet_name: Column) -> Column:
    """Table name before collisions: file stem, then the sheet if there is one."""
    stem = file_stem(source_path)
    sheet = F.when(sheet_name != "", sheet_name)
    return identifier(F.concat_ws("_", stem, sheet))


def name_tables(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``table_name`` to ``(table_id, source_path, sheet_name, ...)``.

    A name that another table holds, in the registry or by a smaller id in the
    same batch, gets the first eight characters of the table id appended; if that
    name is held as well, the whole id. Names are compared through one minimum per
    name, so a name that millions of files share is no hot group.
    """
    named = incoming.withColumn("_base", base_name(F.col("source_path"), F.col("sheet_name")))
    bases = named.groupBy("_base").agg(F.min("table_id").alias("_first"))
    holder = registry.select(F.col("table_name").alias("_held"), F.col("table_id").alias("_holder"))
    owners = bases.join(holder, F.col("_base") == F.col("_held"), "left").select("_base", F.coalesce("_holder", "_first").alias("_owner"))
    named = named.join(owners, "_base")
    # Two ids of the batch may begin alike, and a name with a suffix may be another table's whole name.
    short = F.when(F.col("table_id") != F.col("_owner"), F.concat("_base", F.lit("_"), F.substring("table_id", 1, 8)))
    named = named.withColumn("_short", short)
    none = F.lit(None).cast("string")
    claims = holder.select(F.col("_held").alias("_short"), F.col("_holder"), none.alias("_id"))
    claims = claims.unionByName(bases.select(F.col("_base").alias("_short"), F.col("_first").alias("_holder"), none.alias("_id")))
    claims = claims.unionByName(named.filter(F.col("_short").isNotNull()).select("_short", none.alias("_holder"), F.col("table_id").alias("_id")))
    claims = claims.groupBy("_short").agg(F.collect_set("_holder").alias("_holders"), F.min("_id").alias("_least"))
    named = named.join(claims, "_short", "left")
    others = F.size(F.filter("_holders", lambda one: one != F.col("table_id"))) > 0
    long = F.concat("_base", F.lit("_"), F.col("table_id"))
    name = F.when(F.col("_short").isNull(), F.col("_base")).when(others | (F.col("_least") != F.col("table_id")), long).otherwise(F.col("_short"))
    return named.withColumn("table_name", name).select(*incoming.columns, "table_name")


def register(registry: DataFrame, entries: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Registry with ``entries`` inserted or replaced by ``table_id``."""
    return keyed_upsert(registry, entries, ["table_id"], order)


def lookup(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Registry rows for ``wanted(position, table_id)``, in that order by
    ``position``; unknown ids are skipped. Adds the parsed column list."""
    column_type = "array<struct<name:string,type:string,description:string>>"
    return (
        wanted.join(registry, "table_id")
        .withColumn("columns", F.from_json("columns_json", column_type))
        .drop("columns_json")
    )


def delete_by_source(registry: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry without the tables of ``sources(source_path)``, and their ids."""
    wanted = sources.select("source_path").distinct()
    kept = registry.join(wanted, "source_path", "left_anti")
    gone = registry.join(wanted, "source_path", "left_semi").select("table_id", "table_name")
    return kept.select(*registry.columns), gone


def citation(source_path: Column, sheet_name: Column, table_name: Column) -> Column:
    sheet = F.when(sheet_name != "", F.concat(F.lit(", Sheet: "), sheet_name))
    return F.concat(
        F.lit("[Quelle: "), source_path, F.coalesce(sheet, F.lit("")), F.lit(", Tabelle: "), table_name, F.lit("]")
    )


def schema_summary(table_name: Column, description: Column, columns: Column, row_count: Column) -> Column:
    """One-paragraph schema text: name, description, typed columns, row count."""
    listed = F.array_join(F.transform(columns, lambda c: F.concat(c["name"], F.lit(" ("), c["type"], F.lit(")"))), ", ")
    return F.concat(
        F.lit('Table "'), table_name, F.lit('": '), description,
        F.lit("\n  Columns: "), listed, F.lit("  — "), row_count.cast("string"), F.lit(" rows"),
    )


def default_description(source_path: Column, sheet_name: Column) -> Column:
    """Description used where no describer is plugged in."""
    sheet = F.when(sheet_name != "", F.concat(F.lit(", sheet '"), sheet_name, F.lit("'")))
    return F.concat(F.lit("Table from "), file_name(source_path), F.coalesce(sheet, F.lit("")))


def parse_description(reply: Column, fallback: Column, headers: Column) -> Column:
    """A describer's JSON reply as ``description, columns, error``.

    A reply that is no JSON object gives the fallback text and TEXT columns.
    """
    shape = (
        "struct<description:string,columns:array<struct<name:string,type:string,description:string>>>"
    )
    parsed = F.from_json(reply, shape, {"mode": "PERMISSIVE"})
    valid = F.coalesce(F.try_parse_json(reply).isNotNull() & strip_starts_with_brace(reply), F.lit(False))
    plain = F.transform(
        headers, lambda h: F.struct(h.alias("name"), F.lit("TEXT").alias("type"), F.lit("").alias("description"))
    )
    return F.struct(
        F.when(valid, F.coalesce(parsed["description"], fallback)).otherwise(fallback).alias("description"),
        F.when(valid, F.coalesce(parsed["columns"], F.array().cast("array<struct<name:string,type:string,description:string>>")))
        .otherwise(plain)
        .alias("columns"),
        F.when(~valid, "malformed reply").alias("error"),
    )


def strip_starts_with_brace(reply: Column) -> Column:
    return F.ltrim(reply).startswith("{")


def card_text(description: Column, headers: Column, sample_rows: Column) -> Column:
    """Text under which a table is indexed: description, columns, sample rows.

    ``sample_rows`` is an array of rows, each an array of cells in text form.
    """
    lines = F.concat(
        F.array(headers),
        F.transform(sample_rows, lambda row: F.transform(row, lambda cell: F.coalesce(cell, F.lit("")))),
    )
    sample = F.array_join(F.transform(lines, lambda line: F.concat(F.array_join(line, " | "), F.lit("\n"))), "")
    return F.concat(
        description, F.lit("\n\nColumns: "), F.array_join(headers, ", "), F.lit("\n\nSample data:\n"), sample
    )


def card_metadata(card: DataFrame) -> Column:
    """Metadata map of a card, built from the registry columns of ``card``."""
    names = F.to_json(F.transform("columns", lambda c: c["name"]))
    pairs = {
        "table_id": F.col("table_id"),
        "table_name": F.col("table_name"),
        "source": F.col("source_path"),
        "fileName": file_name(F.col("source_path")),
        "fileHash": F.col("file_hash"),
        "sheetName": F.col("sheet_name"),
        "contentType": F.lit("table"),
        "description": F.col("description"),
        "columns": names,
        "rowCount": F.col("row_count").cast("string"),
    }
    return F.create_map(*[part for key, value in pairs.items() for part in (F.lit(key), value)])


def head_rows(rows: DataFrame, order: Sequence[Column], columns: Sequence[str], n: int = CARD_ROWS) -> DataFrame:
    """First ``n`` rows as one row ``sample_rows array<array<string>>``.

    ``orderBy().limit()`` keeps ``n`` rows per task, so the collected group is
    bounded by ``n``.
    """
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    places = [column.alias(f"_o{i}") for i, column in enumerate(order)]
    first = rows.select(*places, cells.alias("cells")).orderBy(*[f"_o{i}" for i in range(len(order))]).limit(n)
    keyed = F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col("cells"))
    return first.agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda r: r["cells"]).alias("sample_rows"))


def ingest_reply(tables: DataFrame) -> DataFrame:
    """Totals of an ingest from ``(table_id, row_count, columns)``."""
    return tables.agg(
        F.count("*").alias("total_tables"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.size("columns").cast("long")), F.lit(0)).alias("total_columns"),
    )
