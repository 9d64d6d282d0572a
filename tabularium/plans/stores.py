"""Contract queries of what lies on storage: images, logs, erasure over all stores, and batches with undecided paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.images import resolve_markers
from tabularium.plans.contract import contract, read
from tabularium.session import shared_path
from tabularium.sources.collection import collection
from tabularium.sources.imagestore import ImageStore
from tabularium.sources.logs import append_log, read_log, retain_log
from tabularium.sources.tablestore import FILES
from tabularium.streaming.ingest import TORN, IngestTarget, ingest_batch, manifest_table
from tabularium.workspace import Workspace

# Bytes before the size of a PNG and of a GIF, in hex.
_PNG_HEAD, _GIF_HEAD = "89504E470D0A1A0A0000000D49484452", "474946383961"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per document: its text behind a PNG header as wide as it has characters, its language behind a GIF header."""

    def tag(kind: str, data: Column) -> Column:
        return F.concat(F.lit(f'<img src="data:image/{kind};base64,'), F.base64(data), F.lit('">'))

    width = F.lpad(F.hex(F.col("n_chars")), 8, "0")
    png = F.concat(F.unhex(F.concat(F.lit(_PNG_HEAD), width, F.lit("00000010"))), F.col("text").cast("binary"))
    gif = F.concat(F.unhex(F.lit(f"{_GIF_HEAD}02000300")), F.col("lang").cast("binary"))
    path = F.concat("source", F.lit("/"), "doc_id")
    return read(spark, sf, "documents").select(path.alias("source"), F.md5("text").alias("file_hash"), F.concat(tag("png", png), tag("gif", gif)).alias("html"))


# Documents with a toxic label are erased.
_GONE = "gone AS (SELECT doc_id FROM labels WHERE toxic = 1)"


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    toxic = read(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return read(spark, sf, "documents").join(toxic, "doc_id", "left_semi").select(F.concat("source", F.lit("/"), "doc_id").alias("source"))


@contract(
    "image_store",
    f"""WITH {_GONE}, kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
    images AS (
      SELECT source || '/' || doc_id AS source, 0 AS picture_index, 'image/png' AS mimetype, n_chars::INT AS width, 16 AS height, 24 + strlen(text) AS bytes,
             'p' || n_chars || text AS content FROM kept
      UNION ALL SELECT source || '/' || doc_id, 1, 'image/gif', 2, 3, 10 + strlen(lang), 'g' || lang FROM kept)
    SELECT source, picture_index, mimetype, width, height, bytes::BIGINT AS bytes, count(*) OVER (PARTITION BY content) AS refs,
      (SELECT count(DISTINCT content) FROM images) AS contents FROM images""",
)
def image_store(spark: SparkSession, sf: str) -> DataFrame:
    """Images stored once per content, those of some sources erased with the bytes that nobody else refers to."""
    store = ImageStore(spark, shared_path(spark, "images"))
    store.add(_pages(spark, sf))
    store.erase(_gone(spark, sf))
    contents = store.contents.read().agg(F.count("*").alias("contents"))
    rows = store.read().join(store.counts(), "content_hash").join(F.broadcast(contents))
    return rows.select("source", "picture_index", "mimetype", "width", "height", "bytes", F.col("references").alias("refs"), "contents")


_AS_OF = "2024-02-10 12:00:00"


@contract(
    "log_retention",
    f"""WITH kept AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAYS)
    SELECT event_id, ts::DATE AS day, event_type, (SELECT count(*) FROM events) - (SELECT count(*) FROM kept) AS deleted, (SELECT count(*) FROM kept) AS kept FROM kept""",
)
def log_retention(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty-day rule applied to a stored log: whole days dropped, the boundary's day rewritten."""
    root = shared_path(spark, "log")
    append_log(read(spark, sf, "events"), root, "ts")
    reply = retain_log(spark, root, F.lit(_AS_OF).cast("timestamp_ntz"), 30, "ts").first()
    return read_log(spark, root).select("event_id", "day", "event_type", F.lit(reply["deleted"]).alias("deleted"), F.lit(reply["kept"]).alias("kept"))


@contract(
    "erase_stores",
    f"""WITH {_GONE}, erased AS (SELECT source || '/' || doc_id AS source FROM documents WHERE doc_id IN (SELECT doc_id FROM gone)
      UNION ALL SELECT 'in/nation.csv'),
    docs AS (SELECT source || '/' || doc_id AS source, md5(text) AS content, lang, doc_id FROM documents),
    stored AS (
      SELECT 'collection documents' AS store, source, content FROM docs
      UNION ALL SELECT 'images', source, '0 image/png' FROM docs UNION ALL SELECT 'images', source, '1 image/gif' FROM docs
      UNION ALL SELECT 'log questions', source, doc_id::VARCHAR FROM docs
      UNION ALL SELECT 'manifest', source || '/' || doc_id, md5(source || text || doc_id) FROM documents
      UNION ALL SELECT * FROM (VALUES ('table registry', 'in/nation.csv', 'nation'), ('table registry', 'in/region.csv', 'region')))
    SELECT s.*, (SELECT count(*) FROM stored o JOIN erased e ON e.source = o.source WHERE o.store = s.store) AS erased
    FROM stored s WHERE s.source NOT IN (SELECT source FROM erased)""",
)
def erase_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Sources erased from chunks, cards, tables, images, logs and the manifest, and what is left of each store."""
    space = Workspace(spark, shared_path(spark, "space"))
    documents = read(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "doc_id")
    keys = {"source": path, "fileHash": F.md5(F.concat("source", "text", "doc_id")), "fileSize": F.col("n_chars").cast("string"), "contentType": F.col("lang")}
    metadata = F.create_map(*[part for key, value in keys.items() for part in (F.lit(key), value)])
    space.upsert(documents.select(F.col("doc_id").cast("string").alias("id"), "text", metadata.alias("metadata")))
    space.reconcile()
    space.images.add(_pages(spark, sf))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(5)).cast("int"))
    space.append_log("questions", documents.select(path.alias("source"), "doc_id", day.cast("timestamp").alias("created_at")))
    files = []
    for table in ("nation", "region"):
        folder = shared_path(spark, table)
        read(spark, sf, table).write.option("header", "true").csv(folder)
        files.append((folder, f"in/{table}.csv", "h"))
    space.ingest_tables(spark.createDataFrame(files, FILES))
    erased = space.erase_sources(_gone(spark, sf).unionByName(spark.createDataFrame([("in/nation.csv",)], "source string")))
    picture = F.concat_ws(" ", F.col("picture_index").cast("string"), "mimetype")
    left = {
        "collection documents": (space.collection().read(), F.col("source"), F.md5("text")),
        "images": (space.images.read(), F.col("source"), picture),
        "log questions": (read_log(spark, space.log("questions")), F.col("source"), F.col("doc_id").cast("string")),
        "manifest": (space.manifest.read(), F.col("file_path"), F.col("file_hash")),
        "table registry": (space.tables.registry.read(), F.col("source_path"), F.col("table_name")),
    }
    told = [frame.select(F.lit(name).alias("store"), source.alias("source"), content.alias("content")) for name, (frame, source, content) in left.items()]
    return reduce(DataFrame.unionByName, told).join(F.broadcast(erased), "store")


@contract(
    "image_resolve_hot",
    """SELECT doc_id, '![logo](data:logo) ' || text || CASE WHEN l.doc_id IS NULL THEN '[IMAGE:' || md5(d.doc_id::VARCHAR) || ']'
      ELSE '![' || md5(d.doc_id::VARCHAR) || '](u' || d.doc_id || ')' END AS text
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def image_resolve_hot(spark: SparkSession, sf: str) -> DataFrame:
    """One image in every text: its pairs are spread over the tasks."""
    mark = lambda name: F.concat(F.lit("[IMAGE:"), name, F.lit("]"))
    own = F.md5(F.col("doc_id").cast("string"))
    texts = read(spark, sf, "documents").select("doc_id", F.concat(mark(F.lit("logo")), F.lit(" "), "text", mark(own)).alias("text"))
    images = read(spark, sf, "labels").select(own.alias("id"), F.concat(F.lit("u"), "doc_id").alias("uri"))
    logo = spark.createDataFrame([("logo", "data:logo")], "id string, uri string")
    return resolve_markers(texts, images.unionByName(logo), "doc_id")


@contract(
    "ingest_undecided",
    f"""WITH d AS (SELECT source || '/' || doc_id AS file_path, text, lang, doc_id % 4 = 0 AS torn, doc_id % 3 = 0 AS again FROM documents)
    SELECT file_path, CASE WHEN torn AND NOT again THEN least(md5(text), md5('other ' || text)) ELSE md5(text) END AS file_hash,
      CASE WHEN torn THEN '{TORN}' END AS last_error, NOT torn OR again AS has_chunks FROM d""",
)
def ingest_undecided(spark: SparkSession, sf: str) -> DataFrame:
    """A batch in which some paths come in two versions that are equally new: they are recorded, the others go on."""
    files = read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "text", "doc_id")
    target = IngestTarget(shared_path(spark, "collection"), shared_path(spark, "manifest"), compact_every=1)
    # Some paths have been there before, and keep what they had.
    ingest_batch(files.filter(F.col("doc_id") % 3 == 0).select("path", "text"), target)
    other = files.filter(F.col("doc_id") % 4 == 0).select("path", F.concat(F.lit("other "), "text").alias("text"))
    ingest_batch(files.select("path", "text").unionByName(other), target)
    chunks = collection(spark, target.collection).read().select(F.col("source").alias("file_path"), F.lit(True).alias("has")).distinct()
    manifest = manifest_table(spark, target.manifest).read()
    return manifest.join(chunks, "file_path", "left").select("file_path", "file_hash", "last_error", F.coalesce("has", F.lit(False)).alias("has_chunks"))
