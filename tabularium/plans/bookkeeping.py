"""Contract queries of the manifest, erasure, retention and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.activity import hourly_rollup, sessions
from tabularium.operators.lifecycle import (
    detect_changes,
    erase_sources,
    facet,
    ingest_stats,
    reconcile,
    reconcile_reply,
    record_outcomes,
    retain,
    retention_reply,
    scroll,
)
from tabularium.operators.upsert import without_value
from tabularium.plans.contract import contract, read
from tabularium.session import shared_path
from tabularium.sources.logs import append_log, read_log

_NOW = "2024-02-01 00:00:00"
_OLD = "2023-12-01 00:00:00"
_AS_OF = "2024-02-10 00:00:00"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the documents; German ones come without a source."""
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.when(F.col("lang") != "de", F.col("source")).alias("source"),
        F.md5("text").alias("fileHash"),
        F.col("n_chars").cast("string").alias("fileSize"),
        F.col("lang").alias("contentType"),
    )


_POINTS = """
points AS (SELECT doc_id AS id, CASE WHEN lang <> 'de' THEN source END AS source, md5(text) AS "fileHash",
                  n_chars::VARCHAR AS "fileSize", lang AS "contentType" FROM documents),
files AS (SELECT "fileHash" AS file_hash, count(*) AS chunk_count, min_by(coalesce(source, ''), id) AS file_path,
                 min_by("fileSize", id) AS file_size, min_by("contentType", id) AS content_type
          FROM points GROUP BY "fileHash"),
found AS (SELECT * FROM files WHERE file_path <> ''
          QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY chunk_count DESC, file_hash) = 1)"""


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """An older manifest: every document with its path; labelled ones have
    another hash, toxic ones a recorded failure."""
    documents = read(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("hash"), "n_chars", "lang")
    labels = read(spark, sf, "labels")
    joined = documents.join(labels, "doc_id", "left").filter(F.col("lang") != "es")
    return joined.select(
        F.concat("source", F.lit("/"), "doc_id").alias("file_path"),
        F.when(F.col("quality") == 0, F.md5("hash")).otherwise(F.col("hash")).alias("file_hash"),
        F.expr(f"timestamp'{_OLD}'").alias("processed_at"),
        F.ceil(F.col("n_chars") / 1000).alias("chunk_count"),
        F.col("n_chars").cast("string").alias("file_size"),
        F.col("lang").alias("content_type"),
        F.when(F.col("toxic") == 1, "broken file").alias("last_error"),
    )


_MANIFEST = """
manifest AS (
  SELECT source || '/' || doc_id AS file_path, CASE WHEN l.quality = 0 THEN md5(md5(text)) ELSE md5(text) END AS file_hash,
         ceil(n_chars / 1000)::BIGINT AS chunk_count, n_chars::VARCHAR AS file_size, lang AS content_type,
         CASE WHEN l.toxic = 1 THEN 'broken file' END AS last_error
  FROM documents LEFT JOIN labels l USING (doc_id) WHERE lang <> 'es')"""


@contract("facet_source", "SELECT source, count(*) AS count FROM documents GROUP BY source")
def facet_source(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct sources with their counts."""
    return facet(read(spark, sf, "documents"), "source")


@contract(
    "facet_limit",
    """SELECT md5(text) AS "fileHash", count(*) AS count FROM documents GROUP BY 1 ORDER BY count DESC, 1 LIMIT 20""",
)
def facet_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty file hashes with most points."""
    return facet(_points(spark, sf), "fileHash", 20)


@contract(
    "scroll_points",
    "SELECT doc_id AS id, n_chars::VARCHAR AS size FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 25",
)
def scroll_points(spark: SparkSession, sf: str) -> DataFrame:
    """First page of the French points, without vectors."""
    page = scroll(_points(spark, sf), F.col("contentType") == "fr", 25)
    return page.select("id", F.col("fileSize").alias("size"))


@contract(
    "reconcile_manifest",
    f"""WITH {_POINTS}, old AS (
      SELECT DISTINCT source AS file_path FROM documents WHERE lang = 'en' UNION SELECT n_name FROM nation)
    SELECT file_path, file_hash, chunk_count, file_size, content_type, '{_NOW}' AS processed_at, NULL::VARCHAR AS last_error
    FROM found
    UNION ALL SELECT file_path, 'old', 0, '0', 'text', '{_OLD}', 'stale' FROM old
    WHERE file_path NOT IN (SELECT file_path FROM found)""",
)
def reconcile_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rebuilt from the collection over an old one."""
    english = read(spark, sf, "documents").filter(F.col("lang") == "en").select(F.col("source").alias("file_path"))
    paths = english.unionByName(read(spark, sf, "nation").select(F.col("n_name").alias("file_path"))).distinct()
    old = paths.select(
        "file_path",
        F.lit("old").alias("file_hash"),
        F.expr(f"timestamp'{_OLD}'").alias("processed_at"),
        F.lit(0).cast("long").alias("chunk_count"),
        F.lit("0").alias("file_size"),
        F.lit("text").alias("content_type"),
        F.lit("stale").alias("last_error"),
    )
    rebuilt = reconcile(old, _points(spark, sf), F.expr(f"timestamp'{_NOW}'"))
    return rebuilt.withColumn("processed_at", F.col("processed_at").cast("string"))


@contract(
    "reconcile_reply",
    f"""WITH {_POINTS} SELECT count(*) AS distinct_hashes, count(*) FILTER (WHERE file_path <> '') AS processed FROM files""",
)
def reconcile_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct hashes and how many have a path."""
    return reconcile_reply(_points(spark, sf))


@contract(
    "ingest_stats",
    f"""WITH {_MANIFEST} SELECT count(*) AS total_files, coalesce(sum(chunk_count), 0)::BIGINT AS total_chunks,
    '{_OLD}' AS last_processed, round(avg(chunk_count), 2) AS avg_chunks_per_file FROM manifest""",
)
def statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the manifest."""
    return ingest_stats(_manifest(spark, sf)).withColumn("last_processed", F.col("last_processed").cast("string"))


@contract("manifest_count", f"WITH {_MANIFEST} SELECT count(*) AS files FROM manifest")
def manifest_count(spark: SparkSession, sf: str) -> DataFrame:
    """Files the manifest knows."""
    return _manifest(spark, sf).agg(F.count("*").alias("files"))


@contract(
    "change_detect",
    f"""WITH {_MANIFEST}, listing AS (
      SELECT source || '/' || doc_id AS file_path, md5(text) AS file_hash FROM documents WHERE lang <> 'de')
    SELECT coalesce(l.file_path, m.file_path) AS file_path, coalesce(l.file_hash, m.file_hash) AS file_hash,
           CASE WHEN l.file_hash IS NULL THEN 'deleted' WHEN m.file_hash IS NULL THEN 'new'
                WHEN l.file_hash <> m.file_hash THEN 'modified' WHEN m.last_error IS NOT NULL THEN 'failed'
                ELSE 'unchanged' END AS status
    FROM listing l FULL JOIN manifest m ON l.file_path = m.file_path""",
)
def change_detect(spark: SparkSession, sf: str) -> DataFrame:
    """New, modified, unchanged, failed and deleted files."""
    listing = read(spark, sf, "documents").filter(F.col("lang") != "de").select(
        F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.md5("text").alias("file_hash")
    )
    return detect_changes(listing, _manifest(spark, sf))


@contract(
    "delete_by_source",
    f"""WITH {_POINTS}, gone AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
    p AS (SELECT count(*) AS n FROM points WHERE source IS NULL OR source NOT IN (SELECT source FROM gone)),
    d AS (SELECT count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM gone))
    SELECT 'points' AS kind, n AS rows FROM p UNION ALL SELECT 'chunks', n FROM d""",
)
def delete_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Erasure of every source with a toxic document, from points and chunks."""
    documents = read(spark, sf, "documents").select("doc_id", "source")
    toxic = read(spark, sf, "labels").filter(F.col("toxic") == 1)
    sources = documents.join(toxic, "doc_id", "left_semi").select("source")
    kept = erase_sources({"points": (_points(spark, sf), "source"), "chunks": (documents, "source")}, sources)
    counted = [frame.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows")) for kind, frame in kept.items()]
    return counted[0].unionByName(counted[1])


@contract(
    "delete_points",
    f"""WITH {_POINTS} SELECT id, source FROM points WHERE source IS DISTINCT FROM 'src3'""",
)
def delete_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points without those of one source; points without a source stay."""
    return without_value(_points(spark, sf).select("id", "source"), "source", "src3")


def _as_of():
    return F.lit(_AS_OF).cast("timestamp_ntz")


@contract(
    "retention_chat",
    f"""SELECT event_id, user_id FROM events WHERE NOT ts < TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAYS""",
)
def retention_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that survive the thirty-day rule."""
    return retain(read(spark, sf, "events"), _as_of(), time_col="ts").select("event_id", "user_id")


@contract(
    "retention_reply",
    f"""SELECT count(*) FILTER (WHERE ts < TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAYS) AS deleted,
               count(*) FILTER (WHERE ts >= TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAYS) AS kept FROM events""",
)
def retention_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How many messages the rule deletes and keeps."""
    return retention_reply(read(spark, sf, "events"), _as_of(), time_col="ts")


@contract(
    "file_failures",
    f"""WITH {_MANIFEST},
    outcome AS (SELECT source || '/' || doc_id AS file_path, md5(text) AS file_hash, n_chars,
                       CASE WHEN l.quality = 0 THEN 'no text' END AS error, lang
                FROM documents JOIN labels l USING (doc_id)),
    merged AS (
      SELECT o.file_path, CASE WHEN o.error IS NOT NULL AND m.file_hash IS NOT NULL THEN m.file_hash ELSE o.file_hash END AS file_hash,
             CASE WHEN o.error IS NOT NULL THEN coalesce(m.chunk_count, 0) ELSE 1 END AS chunk_count, o.error AS last_error
      FROM outcome o LEFT JOIN manifest m ON m.file_path = o.file_path)
    SELECT * FROM merged UNION ALL
    SELECT file_path, file_hash, chunk_count, last_error FROM manifest WHERE file_path NOT IN (SELECT file_path FROM merged)""",
)
def file_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest after an ingest where files of low quality failed."""
    labels = read(spark, sf, "labels")
    outcome = read(spark, sf, "documents").join(labels, "doc_id").select(
        F.concat("source", F.lit("/"), "doc_id").alias("file_path"),
        F.md5("text").alias("file_hash"),
        F.expr(f"timestamp'{_NOW}'").alias("processed_at"),
        F.lit(1).cast("long").alias("chunk_count"),
        F.col("n_chars").cast("string").alias("file_size"),
        F.col("lang").alias("content_type"),
        F.when(F.col("quality") == 0, "no text").alias("last_error"),
    )
    merged = record_outcomes(_manifest(spark, sf), outcome, [F.desc("processed_at"), F.asc("file_hash")])
    return merged.select("file_path", "file_hash", "chunk_count", "last_error")


@contract(
    "activity_sessions",
    """WITH marked AS (
      SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS opened
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT user_id, ts, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM numbered GROUP BY user_id, s""",
)
def activity_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Activity of every user between idle gaps of ten minutes."""
    return sessions(read(spark, sf, "events"), "user_id", "ts")


@contract(
    "log_rollup",
    """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total
    FROM events GROUP BY ALL""",
)
def log_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type."""
    return hourly_rollup(read(spark, sf, "events"), "ts", "event_type", "value")


@contract(
    "log_append",
    """SELECT ts::DATE AS day, event_type, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL""",
)
def log_append(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log by day, and read back from a day on."""
    root = shared_path(spark, "log")
    append_log(read(spark, sf, "events"), root, "ts")
    return read_log(spark, root, "2024-01-10").groupBy("day", "event_type").agg(F.count("*").alias("events"))
