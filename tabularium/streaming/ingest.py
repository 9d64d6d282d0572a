"""Incremental ingest: new and changed files to an up-to-date collection.

Each micro-batch is compared with the manifest, only what changed is chunked
and encoded, and both tables move on by keyed upserts. Running a batch again
after a failure gives the same tables, so the file source's checkpoint is all
the restart state there is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabularium.functions.markup import text_blocks
from tabularium.functions.payload import point_id
from tabularium.operators.chunking import TOKEN_BUDGET, chunk
from tabularium.operators.dense import Embedder, hashing_embedder
from tabularium.operators.lifecycle import MANIFEST, detect_changes
from tabularium.session import shared_path
from tabularium.sources.collection import build_points, collection
from tabularium.sources.documents import ERROR_TYPE, Parser, parse_documents
from tabularium.sources.files import delete
from tabularium.sources.keyed import KeyedTable, write_rows

FILES = "path string, text string"


@dataclass(frozen=True)
class IngestTarget:
    """Folders of the chunk collection and the manifest, on shared storage."""

    collection: str
    manifest: str
    dimension: int = 64
    token_budget: int = TOKEN_BUDGET
    # Batches after which collection and manifest are compacted.
    compact_every: int = 16
    # Bases before the newest that a compaction leaves, for readers that are still in them.
    keep_bases: int = 1


def manifest_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, root, MANIFEST, ["file_path"]).create()


def chunk_points(parsed: DataFrame, embedder: Embedder, budget: int) -> DataFrame:
    """Points of ``parsed(path, file_hash, file_size, blocks)``, one per chunk."""
    chunks = chunk(parsed, budget, carry=["file_hash", "file_size"])
    keys = {"source": "path", "fileHash": "file_hash", "fileSize": "file_size"}
    metadata = [part for key, column in keys.items() for part in (F.lit(key), F.col(column).cast("string"))]
    items = chunks.select(
        point_id(F.lit(None).cast("string"), F.col("path"), F.col("chunk_index").cast("string")).alias("id"),
        "text",
        F.create_map(*metadata, F.lit("contentType"), F.lit("text")).alias("metadata"),
    )
    return build_points(items, embedder)


# Error of paths whose newest version cannot be told, and of those that gave another content when they were read again.
TORN = "two versions are equally new"
MOVED = "changed while it was read"


def _newest(files: DataFrame) -> DataFrame:
    """``path, file_hash, torn``: one version of each path, the newest; ``torn`` tells where there are several.

    A version without a time may be newer or older than any other, so it stands
    beside the newest. Versions with equal content are one. No content is shuffled here.
    """
    at = F.col("modified_at") if "modified_at" in files.columns else F.lit(None).cast("timestamp").alias("modified_at")
    files = files.select("path", "file_hash", at)
    newest = F.max("modified_at").over(Window.partitionBy("path"))
    at_top = F.col("modified_at").isNull() | (F.col("modified_at") == F.col("newest"))
    latest = files.withColumn("newest", newest).filter(at_top).select("path", "file_hash").dropDuplicates()
    order = Window.partitionBy("path")
    latest = latest.withColumn("torn", F.count("*").over(order) > 1).withColumn("_first", F.min("file_hash").over(order))
    # Of a torn path one row is left to carry the error.
    return latest.filter(F.col("file_hash") == F.col("_first")).drop("_first")


def _stored(frame: DataFrame, root: str) -> DataFrame:
    """What several steps use, on shared storage: kept by executors it would fill their memory, more of it with every file."""
    write_rows(frame, root)
    return frame.sparkSession.read.schema(frame.schema).parquet(root)


def _bring(files: DataFrame, parse: Callable[[DataFrame], DataFrame], target: IngestTarget, embedder: Embedder | None) -> DataFrame:
    """Ingest ``files(path, file_hash, ...)``; ``parse`` turns those that changed into ``path, file_hash, file_size, blocks, errors``.

    Files are read twice: for what changed, by paths and hashes alone, and for the content of that.
    """
    spark = files.sparkSession
    embedder = embedder or hashing_embedder(target.dimension)
    points = collection(spark, target.collection)
    manifest = manifest_table(spark, target.manifest)
    scratch = shared_path(spark, "ingest")
    listing = _stored(_newest(files).withColumnRenamed("path", "file_path"), f"{scratch}/listing")
    # Only the manifest rows of this batch take part, so the manifest is not shuffled.
    known = manifest.read().join(listing.select("file_path"), "file_path", "left_semi")
    old = known.select("file_path", F.col("file_hash").alias("old_hash"), F.col("chunk_count").alias("old_chunks"))
    torn = listing.filter("torn").select(F.col("file_path").alias("_path"), "torn")
    changes = detect_changes(listing, known).join(torn, F.col("file_path").eqNullSafe(F.col("_path")), "left").drop("_path").join(old, "file_path", "left")
    # Undecided paths are failures like any other: what they had stays, the error is recorded, and the batch goes on.
    changes = _stored(changes.withColumn("status", F.when(F.col("torn"), "failed").otherwise(F.col("status"))), f"{scratch}/changes")
    todo = changes.filter(F.col("status") != "unchanged")
    wanted = todo.filter(F.col("torn").isNull()).select(F.col("file_path").alias("path"), "file_hash")
    # The join sorts by path and hash, so equal versions lie side by side.
    arrived = files.join(wanted, ["path", "file_hash"], "left_semi").dropDuplicates(["path", "file_hash"])
    parsed = _stored(parse(arrived).select("path", "file_hash", "file_size", "blocks", "errors"), f"{scratch}/parsed")
    good = parsed.filter(F.size("errors") == 0)
    number = points.upsert(chunk_points(good, embedder, target.token_budget), key="source", replaced=good.select("path"))
    # Counts come from the written batch: chunks are not computed a second time.
    counts = points.batch(number).groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("chunks"))
    outcomes = parsed.select(
        F.col("path").alias("file_path"),
        "file_size",
        (F.size("errors") > 0).alias("_failed"),
        F.get("errors", F.lit(0))["error_message"].alias("_error"),
    )
    failed = F.coalesce("_failed", F.lit(True))
    entries = (
        todo.filter(F.col("file_path").isNotNull() | F.col("torn"))
        .join(outcomes, "file_path", "left")
        .join(counts, "file_path", "left")
        .select(
            "file_path",
            # A file that fails keeps the chunks of its last success, and so their hash.
            F.when(failed, F.coalesce("old_hash", "file_hash")).otherwise(F.col("file_hash")).alias("file_hash"),
            F.current_timestamp().alias("processed_at"),
            F.coalesce(F.when(failed, F.col("old_chunks")).otherwise(F.col("chunks")), F.lit(0).cast("long")).alias("chunk_count"),
            F.col("file_size").cast("string").alias("file_size"),
            F.lit("text").alias("content_type"),
            F.when(F.col("torn"), TORN).when(F.col("_failed").isNull(), MOVED).otherwise(F.col("_error")).alias("last_error"),
        )
    )
    manifest.upsert(entries)
    # The reply outlives the batch, what it was worked out from does not.
    for name in ("listing", "parsed"):
        delete(spark, f"{scratch}/{name}")
    if target.compact_every and number >= target.compact_every:
        for table in (points, manifest):
            table.compact()
            # Readers that began before the compaction may still be in the last base.
            table.forget(target.keep_bases)
    return changes.select("file_path", "file_hash", "status")


def ingest_batch(files: DataFrame, target: IngestTarget, embedder: Embedder | None = None) -> DataFrame:
    """Bring collection and manifest up to date with plain texts, ``files(path, text[, modified_at])``.

    Of several versions of a path the newest counts. Where that cannot be told (two
    different texts are equally new, or one has no time) the path is recorded in
    the manifest as failed and keeps what it had, while the rest of the batch goes on.
    Returns the changes found, one narrow row per file of the batch. A modified
    file loses all its old chunks first, so a shorter version leaves none behind.
    Files that are absent from the batch are not touched.
    """

    def parse(rows: DataFrame) -> DataFrame:
        none = F.array().cast(ERROR_TYPE).alias("errors")
        return rows.select("path", "file_hash", F.length("text").alias("file_size"), text_blocks(F.col("text")).alias("blocks"), none)

    return _bring(files.withColumn("file_hash", F.md5("text")), parse, target, embedder)


def ingest_files(files: DataFrame, target: IngestTarget, embedder: Embedder | None = None, parser: Parser | None = None) -> DataFrame:
    """The same for document files, ``path, file_hash, file_size, content[, modified_at]``, each parsed by its kind.

    A file that cannot be parsed leaves its error in the manifest, where it is
    found again and retried by the next call; what it had in the collection stays.
    """
    return _bring(files, lambda rows: parse_documents(rows, parser), target, embedder)


def remove_missing(listing: DataFrame, target: IngestTarget) -> DataFrame:
    """Drop chunks and manifest rows of files that a full ``listing(file_path,
    file_hash)`` no longer names; returns their paths."""
    spark = listing.sparkSession
    manifest = manifest_table(spark, target.manifest)
    missing = manifest.read().select("file_path").join(listing.select("file_path"), "file_path", "left_anti")
    missing = missing.persist(StorageLevel.MEMORY_AND_DISK)
    collection(spark, target.collection).delete("source", missing)
    manifest.delete("file_path", missing)
    return missing


def ingest_stream(
    files: DataFrame, target: IngestTarget, checkpoint: str, embedder: Embedder | None = None, parser: Parser | None = None
) -> StreamingQuery:
    """Start incremental ingest of a stream of texts, or of document files where
    there is a column ``content``; runs until the available input is used up."""

    def handle(batch: DataFrame, _: int) -> None:
        if "content" in batch.columns:
            ingest_files(batch, target, embedder, parser)
        else:
            ingest_batch(batch, target, embedder)

    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of ``(path, text, modified_at)`` from Parquet files of ``path, text`` dropped in a folder; a row is as new as its file."""
    rows = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select("path", "text", F.col("_metadata.file_modification_time").alias("modified_at"))
