"""All jobs on one folder of shared storage: collections, tables and manifest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.payload import payload, point_id
from tabularium.operators.cells import (
    assign_cells,
    cell_top_k,
    measure_cells,
    read_bounds,
    train_centres,
    write_bounds,
    write_cells,
)
from tabularium.operators.chunking import TOKEN_BUDGET, chunk, export_documents
from tabularium.operators.dense import Embedder, hashing_embedder
from tabularium.operators.lifecycle import CHAT_DAYS, found_files, hash_order, ingest_stats, reconcile_reply
from tabularium.operators.postings import postings_top_k, write_postings
from tabularium.operators.ranking import latest
from tabularium.operators.rerank import Scorer, overlap_scorer
from tabularium.operators.search import DOCUMENT_SEARCH, TABLE_SEARCH, SearchOptions, hybrid_search
from tabularium.operators.sparse import stored_stats
from tabularium.operators.sqlguard import answer
from tabularium.operators.upsert import upsert_counts
from tabularium.session import shared_path
from tabularium.sources.collection import build_points, checked, collection
from tabularium.sources.documents import Parser, parse_documents, read_files
from tabularium.sources.files import delete, is_committed, list_names
from tabularium.sources.imagestore import ImageStore
from tabularium.sources.keyed import KeyedTable
from tabularium.sources.logs import append_log, erase_from_log, retain_log
from tabularium.sources.tablestore import Describer, TableStore
from tabularium.streaming.ingest import IngestTarget, ingest_files, manifest_table

DEFAULT_COLLECTION = "documents"


@dataclass
class Workspace:
    """Entry point for users: every job of the engine with its stored state.

    ``embedder`` and ``scorer`` are the model plug-ins; the built-in ones need
    no model. ``dimension`` is that of the embedder.
    """

    spark: SparkSession
    root: str
    dimension: int = 64
    embedder: Embedder | None = None
    scorer: Scorer = overlap_scorer

    @property
    def _embedder(self) -> Embedder:
        return self.embedder or hashing_embedder(self.dimension)

    def collection(self, name: str = DEFAULT_COLLECTION) -> KeyedTable:
        return collection(self.spark, f"{self.root}/collections/{name}")

    @property
    def tables(self) -> TableStore:
        return TableStore(self.spark, f"{self.root}/tables", self.dimension)

    @property
    def manifest(self) -> KeyedTable:
        return manifest_table(self.spark, f"{self.root}/manifest")

    # Documents

    def chunk_files(
        self, path: str, parser: Parser | None = None, budget: int = TOKEN_BUDGET, include_raw_text: bool = False
    ) -> DataFrame:
        """Chunks of every file below ``path``, with the file's hash."""
        parsed = parse_documents(read_files(self.spark, path), parser)
        return chunk(parsed, budget, include_raw_text, carry=["file_hash", "file_size"])

    def export_files(self, path: str, parser: Parser | None = None) -> DataFrame:
        """Converted documents of every file below ``path``, with their status."""
        return export_documents(parse_documents(read_files(self.spark, path), parser))

    def ingest_files(self, path: str, parser: Parser | None = None, name: str = DEFAULT_COLLECTION, budget: int = TOKEN_BUDGET) -> DataFrame:
        """Bring a collection and the manifest up to date with every file below ``path``: parsed, cut, encoded, upserted.

        Returns ``file_path, file_hash, status``. Unchanged files cost a hash;
        files that fail are recorded with their error and tried again next time.
        """
        target = IngestTarget(f"{self.root}/collections/{name}", f"{self.root}/manifest", self.dimension, budget)
        return ingest_files(read_files(self.spark, path), target, self._embedder, parser)

    def upsert(self, documents: DataFrame, name: str = DEFAULT_COLLECTION) -> DataFrame:
        """Upsert ``documents(id, text, metadata)``; returns the counts of rows
        handed in and of distinct ids."""
        given = point_id(F.col("id").cast("string"), F.try_element_at("metadata", F.lit("source")), F.col("text"))
        identified = documents.select(given.alias("id"), "text", "metadata")
        # One row of an id is chosen before it is encoded: a point is several times as large as its text.
        told = identified.withColumn("_told", F.xxhash64(payload(F.col("text"), F.col("metadata"))))
        chosen = latest(told, ["id"], [F.asc("_told"), F.asc("text"), F.asc(F.to_json("metadata"))]).drop("_told")
        self.collection(name).upsert(checked(build_points(chosen, self._embedder), self.dimension))
        return upsert_counts(identified.select("id"), ["id"])

    def search(
        self, queries: DataFrame, options: SearchOptions = DOCUMENT_SEARCH, name: str = DEFAULT_COLLECTION
    ) -> DataFrame:
        """Answer ``queries(query_id, query[, keywords])`` from a stored collection."""
        return self._search(self.collection(name), f"{self.root}/search/{name}", queries, options)

    def search_tables(self, queries: DataFrame, options: SearchOptions = TABLE_SEARCH) -> DataFrame:
        """Tables that may answer the queries, found by their cards."""
        return self._search(self.tables.cards, f"{self.root}/search-tables", queries, options)

    def prepare_search(self, name: str = DEFAULT_COLLECTION, cells: int = 0, fraction: float = 1.0) -> None:
        """Write what speeds up searches of the collection as it is now: term
        statistics, postings and, with ``cells``, a copy of the vectors laid out in cells.

        All belong to one state of the collection and are not used for another,
        so results never depend on whether this was run.
        """
        self._prepare(self.collection(name), f"{self.root}/search/{name}", cells, fraction)

    def prepare_table_search(self, cells: int = 0, fraction: float = 1.0) -> None:
        """The same for the cards by which tables are found."""
        self._prepare(self.tables.cards, f"{self.root}/search-tables", cells, fraction)

    def _prepare(self, table: KeyedTable, prepared: str, cells: int, fraction: float) -> None:
        folder, points = f"{prepared}/{table.state()}", table.read()
        if not is_committed(self.spark, f"{folder}/terms"):
            stored_stats(points).write.mode("overwrite").parquet(f"{folder}/terms")
        if not is_committed(self.spark, f"{folder}/postings"):
            write_postings(points, f"{folder}/postings")
        if cells and not is_committed(self.spark, f"{folder}/bounds"):
            vectors = points.select("id", "dense")
            centres = train_centres(vectors, cells, self.dimension, fraction)
            write_cells(assign_cells(vectors, centres), f"{folder}/placed")
            placed = self.spark.read.parquet(f"{folder}/placed")
            write_bounds(measure_cells(placed, centres), placed, f"{folder}/bounds")

    def compact(self, name: str = DEFAULT_COLLECTION, keep: int = 1) -> None:
        """Fold the batches of a collection and of the manifest into new bases; ``keep`` old ones are left for readers still in them."""
        for table in (self.collection(name), self.manifest):
            table.compact()
            table.forget(keep)

    def _search(self, table: KeyedTable, prepared: str, queries: DataFrame, options: SearchOptions) -> DataFrame:
        folder, read = f"{prepared}/{table.state()}", self.spark.read
        points = table.read().withColumn("metadata", F.from_json("payload", "map<string,string>"))
        stats = read.parquet(f"{folder}/terms") if is_committed(self.spark, f"{folder}/terms") else stored_stats(points)
        dense = None
        if is_committed(self.spark, f"{folder}/bounds"):
            placed, bounds = read.parquet(f"{folder}/placed"), read_bounds(read.parquet(f"{folder}/bounds"))

            def dense(asked: DataFrame, limit: int) -> DataFrame:
                return cell_top_k(placed, bounds, asked, limit)

        sparse = None
        if is_committed(self.spark, f"{folder}/postings"):
            postings = read.parquet(f"{folder}/postings")

            def sparse(asked: DataFrame, limit: int) -> DataFrame:
                return postings_top_k(postings, stats, asked, limit, options.bm25)

        return hybrid_search(points, queries, options, self._embedder, self.scorer, stats, dense, sparse)

    # Bookkeeping

    def reconcile(self, name: str = DEFAULT_COLLECTION) -> DataFrame:
        """Bring the manifest in line with a collection; returns the counts."""
        points = self.collection(name).read()
        self.manifest.upsert(found_files(points, F.current_timestamp()), order=hash_order())
        return reconcile_reply(points)

    def manifest_count(self) -> int:
        return self.manifest.read().count()

    def ingest_stats(self) -> DataFrame:
        return ingest_stats(self.manifest.read())

    # Tables

    def ingest_tables(self, files: DataFrame, describer: Describer | None = None) -> DataFrame:
        """Load any number of delimited files ``path, source_path, file_hash`` in a fixed number of jobs."""
        return self.tables.ingest_all(files, describer, self._embedder)

    def ingest_table(self, path: str, source_path: str, file_hash: str, describer: Describer | None = None) -> DataFrame:
        return self.tables.ingest(path, source_path, file_hash, describer, self._embedder)

    def query_tables(self, sql: str, table_ids: Sequence[str]) -> DataFrame:
        """Answer package of a read-only statement over registered tables."""
        tables = self.tables
        schemas = tables.schemas(table_ids)
        return answer(self.spark, sql, schemas, tables.readers(schemas))

    # Images and logs

    @property
    def images(self) -> ImageStore:
        return ImageStore(self.spark, f"{self.root}/images")

    def log(self, name: str) -> str:
        """Folder of a log by its name."""
        return f"{self.root}/logs/{name}"

    def append_log(self, name: str, entries: DataFrame, time_col: str = "created_at") -> None:
        append_log(entries, self.log(name), time_col)

    def retain_log(self, name: str, as_of: datetime | Column, days: int = CHAT_DAYS, time_col: str = "created_at") -> DataFrame:
        """Drop what is older than ``days`` from a stored log; returns ``deleted, kept``."""
        return retain_log(self.spark, self.log(name), as_of, days, time_col)

    # Erasure

    def stores(self) -> list[Store]:
        """Everything on storage that tells its source, and how to erase it."""
        found = [Store(f"collection {name}", "source", self.collection(name)) for name in list_names(self.spark, f"{self.root}/collections")]
        found += [Store("manifest", "file_path", self.manifest), Store("table registry", "source_path", self.tables.registry), Store("table cards", "source", self.tables.cards)]
        found.append(Store("images", "source", self.images.references, self.images.erase))
        for name in list_names(self.spark, f"{self.root}/logs"):
            path = self.log(name)
            if "source" in self.spark.read.parquet(path).columns:
                found.append(Store(f"log {name}", "source", path, lambda sources, path=path: erase_from_log(self.spark, path, "source", sources)))
        return found

    def erase_sources(self, sources: DataFrame) -> DataFrame:
        """Erase ``sources(source)`` from every store; returns ``store, erased``, the rows each one held.

        Tables are compacted, and their older states and all that was prepared from
        them deleted, so that nothing of the sources is left on storage. Every
        store is looked through afterwards; a source that is still found stops the job.
        """
        path = shared_path(self.spark, "erase")
        sources.select(F.col("source").cast("string").alias("source")).distinct().write.parquet(path)
        wanted = self.spark.read.parquet(path)
        stores = self.stores()
        held = [(store.name, store.count(wanted)) for store in stores]
        self.tables.delete_sources(wanted)
        for store, (_, n) in zip(stores, held, strict=True):
            # A store that never held them, nor anything that was replaced since, is left as it is.
            if n or not store.is_compact():
                store.remove(wanted)
        for name in list_names(self.spark, f"{self.root}/collections"):
            delete(self.spark, f"{self.root}/search/{name}")
        delete(self.spark, f"{self.root}/search-tables")
        left = {store.name: n for store, (_, before) in zip(stores, held, strict=True) if before and (n := store.count(wanted))}
        if left:
            raise RuntimeError(f"sources are left after their erasure: {left}")
        return self.spark.createDataFrame(held, "store string, erased long")

    def erase_source(self, source_path: str) -> list[str]:
        """The same for one source; returns the ids of the tables that went."""
        ids = self.tables.registry.read().filter(F.col("source_path") == source_path).select("table_id").collect()
        self.erase_sources(self.spark.createDataFrame([(source_path,)], "source string"))
        return [row["table_id"] for row in ids]


@dataclass(frozen=True)
class Store:
    """Rows that tell their source in ``column``: a keyed table, or the folder of a log."""

    name: str
    column: str
    held: KeyedTable | str
    erase: Callable[[DataFrame], object] | None = None

    def count(self, wanted: DataFrame) -> int:
        """How many of its rows are of ``wanted(source)``."""
        spark = wanted.sparkSession
        if isinstance(self.held, str) and not any(n.startswith("day=") for n in list_names(spark, self.held)):
            return 0
        rows = spark.read.parquet(self.held) if isinstance(self.held, str) else self.held.read()
        return rows.select(F.col(self.column).cast("string").alias("source")).join(wanted, "source", "left_semi").count()

    def is_compact(self) -> bool:
        return not isinstance(self.held, KeyedTable) or self.held.is_compact()

    def remove(self, wanted: DataFrame) -> None:
        if self.erase is not None:
            self.erase(wanted)
        else:
            self.held.delete(self.column, wanted)
            self.held.compact()
            self.held.forget()
