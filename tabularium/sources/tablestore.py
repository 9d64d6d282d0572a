"""Table files as typed, registered and searchable tables.

A batch of files of any number and shape is loaded by a fixed number of jobs. All
records are written once as rows of cells. Types come from one aggregation over
(table, column position), headers, samples and counts from one per table. The typed
rows of all tables are written by one job, partitioned by table: each value goes to
the slot of its column's position and type, and a table is read by giving its slots
their column names. So pruning and pushed filters work as on any Parquet file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.coercion import TYPE_LABELS, clean_cell, coerce_clean, type_evidence, type_from_evidence
from tabularium.functions.text import file_extension
from tabularium.operators.dense import Embedder, hashing_embedder
from tabularium.operators.ranking import top_k
from tabularium.operators.sqlguard import TableSource
from tabularium.operators.tables import (
    CARD_ROWS,
    RESCUED,
    card_metadata,
    card_text,
    default_description,
    lookup,
    name_tables,
    parse_description,
)
from tabularium.session import shared_path
from tabularium.sources.collection import build_points, checked, collection
from tabularium.sources.delimited import DELIMITERS, header_names, is_header, records_and_files
from tabularium.sources.files import delete, plain_uri, qualified
from tabularium.sources.keyed import KeyedTable

REGISTRY = (
    "table_id string, table_name string, source_path string, file_hash string, sheet_name string, "
    "description string, columns_json string, row_count long, created_at timestamp"
)
REPLY = "table_id string, table_name string, sheet_name string, description string, row_count long, column_count int"
FILES = "path string, source_path string, file_hash string"

# Card text -> JSON reply with a description and column types, as a column; e.g. a pandas UDF around a model.
Describer = Callable[[Column], Column]


class UnsupportedFormat(ValueError):
    """No reader takes files with this extension."""


def _slot(position: int, label: str) -> str:
    return f"c{position}_{TYPE_LABELS[label]}"


@dataclass(frozen=True)
class TableStore:
    """Folders of the registry, the table data and the card collection."""

    spark: SparkSession
    root: str
    dimension: int = 64

    @property
    def registry(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/registry", REGISTRY, ["table_id", "source_path"]).create()

    @property
    def cards(self) -> KeyedTable:
        return collection(self.spark, f"{self.root}/cards")

    def location(self, table_name: str, file_hash: str | None) -> str:
        """Data folder of one state of a table; a new state never overwrites an old one."""
        return f"{self.root}/data/table_name={table_name}/state={_state(file_hash)}"

    def ingest(
        self, path: str, source_path: str, file_hash: str, describer: Describer | None = None, embedder: Embedder | None = None
    ) -> DataFrame:
        """Read one delimited file, type its columns, store and register it; see ``ingest_all``."""
        reply = self.ingest_all(self.spark.createDataFrame([(path, source_path, file_hash)], FILES), describer, embedder)
        failed = reply.filter("error is not null").first()
        if failed:
            raise UnsupportedFormat(failed["error"])
        return reply.drop("source_path", "error")

    def ingest_all(self, files: DataFrame, describer: Describer | None = None, embedder: Embedder | None = None) -> DataFrame:
        """Load ``files(path, source_path, file_hash)``, each a delimited file or a folder of parts with a header each.

        Returns ``source_path, table_id, table_name, sheet_name, description,
        row_count, column_count, error``: one row per table, and one with an error for
        each file that no reader takes. Empty files give no row; of several files
        with one source path the one with the last path counts. A source loaded
        again takes the place of its old table.
        """
        listed = files.groupBy("source_path").agg(F.max(F.struct("path", "file_hash")).alias("f"), file_extension(F.col("source_path")).alias("extension"))
        # The list of paths is on the driver, as Spark's own list of files is.
        rows = listed.select("source_path", "f.path", "f.file_hash", "extension").collect()
        good = [r for r in rows if r["extension"] in DELIMITERS]
        bad = [(r["source_path"], f"Unsupported table file format: {r['extension']}") for r in rows if r["extension"] not in DELIMITERS]
        failed = self.spark.createDataFrame(bad, "source_path string, error string")
        shape = f"source_path string, {REPLY}, error string"
        if not good:
            return self.spark.createDataFrame([], shape).unionByName(failed, allowMissingColumns=True)
        sources = self.spark.createDataFrame([(_table_id(r["source_path"], None), r["source_path"], r["file_hash"], None) for r in good], SOURCES)
        records = None
        for extension, delimiter in DELIMITERS.items():
            own = [(r["path"], qualified(self.spark, r["path"]), _table_id(r["source_path"], None)) for r in good if r["extension"] == extension]
            if own:
                part = _with_table(*records_and_files(self.spark, sorted({path for path, _, _ in own}), delimiter), [(uri, table) for _, uri, table in own])
                records = part if records is None else records.unionByName(part)
        loaded = self.load(records.withColumn("is_header", is_header()), sources, describer, embedder)
        return loaded.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)

    def load(self, records: DataFrame, sources: DataFrame, describer: Describer | None = None, embedder: Embedder | None = None) -> DataFrame:
        """Store and register the tables ``sources(table_id, source_path, file_hash, sheet_name)``.

        ``records`` has ``table_id, file, split, number, cells, is_header``; the three
        in the middle order a table's records. Returns the rows of ``ingest_all``
        without the error.
        """
        path = shared_path(self.spark, "records")
        records.select("table_id", "file", "split", "number", "cells", "is_header").write.parquet(path)
        records = self.spark.read.parquet(path)
        path = shared_path(self.spark, "loaded")
        self._described(records, sources, describer).write.parquet(path)
        tables = self.spark.read.parquet(path)
        self._write_rows(records, tables)
        self.registry.upsert(
            tables.select(
                *[F.to_json("columns").alias(n) if n == "columns_json" else F.current_timestamp().alias(n) if n == "created_at" else F.col(n) for n in self.registry.schema.names]
            )
        )
        items = tables.select(F.col("table_id").alias("id"), F.col("card").alias("text"), card_metadata(tables).alias("metadata"))
        self.cards.upsert(checked(build_points(items, embedder or hashing_embedder(self.dimension)), self.dimension))
        return tables.select("source_path", "table_id", "table_name", "sheet_name", "description", "row_count", F.size("columns").alias("column_count"))

    def _described(self, records: DataFrame, sources: DataFrame, describer: Describer | None) -> DataFrame:
        """One row per table that has a header: its registry columns, sample and card."""
        place = ["file", "split", "number"]
        headers = records.filter("is_header").groupBy("table_id").agg(header_names(F.min_by("cells", F.struct(*place))).alias("names"))
        data = records.filter("not is_header")
        counts = data.groupBy("table_id").agg(F.count("*").alias("row_count"))
        first = top_k(data, ["table_id"], [F.col(c) for c in place], CARD_ROWS, spread_by="number")
        sample = first.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cells"))), lambda r: r["cells"]).alias("sample"))
        # Cells are cleaned in a step of their own, so that five counts share one cleaning.
        cells = data.select("table_id", F.posexplode("cells").alias("position", "cell")).select("table_id", "position", clean_cell(F.col("cell")).alias("clean"))
        evidence = cells.groupBy("table_id", "position").agg(F.struct(*type_evidence(F.col("clean"))).alias("evidence"))
        typed = evidence.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("position", type_from_evidence(F.col("evidence"))))).alias("found"))
        tables = headers
        for more in (counts, sample, typed):
            tables = tables.join(more, "table_id", "left")
        tables = name_tables(tables.join(sources, "table_id"), self.registry.read())
        width = F.size("names")
        plain = default_description(F.col("source_path"), F.col("sheet_name"))
        fitted = F.transform(F.coalesce("sample", F.array().cast("array<array<string>>")), lambda row: F.transform("names", lambda _, i: F.get(row, i)))
        tables = tables.withColumns({"sample_rows": fitted, "row_count": F.coalesce("row_count", F.lit(0)).cast("long"), "description": plain})
        nothing = F.struct(plain.alias("description"), F.array().cast("array<struct<name:string,type:string,description:string>>").alias("columns"), F.lit(None).cast("string").alias("error"))
        told = parse_description(describer(card_text(plain, F.col("names"), F.col("sample_rows"))), plain, F.col("names")) if describer else nothing
        tables = tables.withColumn("told", told)
        replies = F.when(F.col("told.error").isNull(), F.col("told.columns"))

        def column(name: Column, position: Column) -> Column:
            reply = F.get(F.reverse(F.filter(replies, lambda c: c["name"] == name)), F.lit(0))
            kind = F.upper(reply["type"])
            found = F.try_element_at("found", position)
            return F.struct(
                name.alias("name"), F.coalesce(F.when(kind.isin(*TYPE_LABELS), kind), found, F.lit("TEXT")).alias("type"),
                F.coalesce(reply["description"], F.lit("")).alias("description"),
            )

        tables = tables.withColumn("columns", F.when(width > 0, F.transform("names", column))).withColumn("description", F.col("told.description"))
        card = card_text(F.col("description"), F.col("names"), F.col("sample_rows"))
        return tables.withColumn("card", card).drop("told", "found", "sample")

    def _write_rows(self, records: DataFrame, tables: DataFrame) -> None:
        """All tables' rows by one job. A header record becomes an empty row that only says that the table is there."""
        used = tables.select(F.posexplode("columns").alias("position", "column")).select("position", "column.type").distinct()
        # As many slots as there are pairs of a position and a type.
        slots = sorted({(r["position"], TYPE_LABELS[r["type"]]) for r in used.collect()})
        kinds = F.transform("columns", lambda c: c["type"])
        state = F.md5(F.coalesce("file_hash", F.lit(""))).alias("state")
        shapes = tables.select("table_id", "table_name", state, "names", kinds.alias("kinds"))
        fitted = F.when(~F.col("is_header"), F.transform("kinds", lambda kind, i: F.struct(kind.alias("kind"), F.get("cells", i).alias("raw"))))
        rows = records.join(shapes, "table_id").select("table_name", "state", "names", "is_header", fitted.alias("cells"))
        # Cleaning and typing are steps of their own: each result is used more than once.
        rows = rows.withColumn("cells", F.transform("cells", lambda c: F.struct(c["kind"], c["raw"], clean_cell(c["raw"]).alias("clean"))))

        by_type: dict[str, list[str]] = {}
        for label, kind in TYPE_LABELS.items():
            by_type.setdefault(kind, []).append(label)

        def values(c: Column) -> Column:
            return F.struct(*[F.when(c["kind"].isin(*labels), coerce_clean(c["clean"], c["raw"], labels[0])).alias(kind) for kind, labels in by_type.items()])

        rows = rows.withColumn("typed", F.transform("cells", values))
        fits = F.zip_with("cells", "typed", lambda c, t: c["clean"].isNull() | F.coalesce(*[F.when(t[kind].isNotNull(), F.lit(True)) for kind in by_type], F.lit(False)))
        kept = F.filter(F.zip_with(F.arrays_zip("names", "cells"), fits, lambda one, fit: F.struct(one["names"].alias("key"), one["cells"]["raw"].alias("value"), fit.alias("fit"))), lambda one: ~one["fit"])
        spare = F.map_from_entries(F.transform(kept, lambda one: F.struct(one["key"], one["value"])))
        columns = [F.get("typed", F.lit(p))[kind].alias(f"c{p}_{kind}") for p, kind in slots]
        whole = rows.select("table_name", "state", (~F.col("is_header")).alias("is_row"), F.when(F.size(kept) > 0, spare).alias(RESCUED), *columns)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name", "state").parquet(f"{self.root}/data")

    def schemas(self, table_ids: Sequence[str]) -> DataFrame:
        """Registry rows of the tables asked for, with their ``position``."""
        wanted = self.spark.createDataFrame(list(enumerate(table_ids)), "position int, table_id string")
        return lookup(self.registry.read(), wanted)

    def readers(self, schemas: DataFrame) -> dict[str, TableSource]:
        """What reads each table by its name, for a guarded run over the tables asked for."""

        def reader(path: str, columns: list) -> TableSource:
            def read(session: SparkSession) -> DataFrame:
                shape = ", ".join(["is_row boolean", f"{RESCUED} map<string,string>", *[f"{_slot(i, c['type'])} {TYPE_LABELS[c['type']]}" for i, c in enumerate(columns)]])
                rows = session.read.schema(shape).parquet(path).filter("is_row")
                return rows.select(*[F.col(_slot(i, c["type"])).alias(c["name"]) for i, c in enumerate(columns)], RESCUED)

            return read

        rows = schemas.select("table_name", "file_hash", "columns").collect()
        return {row["table_name"]: reader(self.location(row["table_name"], row["file_hash"]), row["columns"]) for row in rows}

    def read(self, table_id: str) -> DataFrame:
        """One table by its id."""
        return next(iter(self.readers(self.schemas([table_id])).values()))(self.spark)

    def delete_sources(self, sources: DataFrame) -> list[str]:
        """Drop the tables of ``sources(source)``: data, registry rows and cards. Returns the ids of the tables that went."""
        values = sources.select("source")
        gone = self.registry.read().join(values, F.col("source_path") == F.col("source"), "left_semi").select("table_id", "table_name").collect()
        self.registry.delete("source_path", values)
        self.cards.delete("source", values)
        for row in gone:
            delete(self.spark, f"{self.root}/data/table_name={row['table_name']}")
        return [row["table_id"] for row in gone]

    def delete_source(self, source_path: str) -> list[str]:
        return self.delete_sources(self.spark.createDataFrame([(source_path,)], "source string"))


SOURCES = "table_id string, source_path string, file_hash string, sheet_name string"


def _table_id(source_path: str, sheet_name: str | None) -> str:
    return hashlib.md5(f"{source_path}\x1f{sheet_name or ''}".encode()).hexdigest()


def _state(file_hash: str | None) -> str:
    return hashlib.md5((file_hash or "").encode()).hexdigest()


def _with_table(records: DataFrame, names: list[str], tables: list[tuple[str, str]]) -> DataFrame:
    """Records of the files ``names`` with the id of their table: that of their file or of the folder it is a part of."""
    spark = records.sparkSession
    known = spark.createDataFrame(tables, "root string, table_id string")
    plain = plain_uri(F.col("file"))
    roots = F.explode(F.array(plain, F.regexp_replace(plain, r"/[^/]*\z", "")))
    # A file that is named itself belongs to no folder.
    found = spark.createDataFrame([(name,) for name in names], "file string").select("file", roots.alias("root")).join(known, "root")
    longest = F.max(F.length("root")).over(Window.partitionBy("file"))
    files = found.withColumn("longest", longest).filter(F.length("root") == F.col("longest")).select("file", "table_id")
    # As many rows as there are files, from the driver's list: records stay where they are read.
    return records.join(F.broadcast(files), "file")
