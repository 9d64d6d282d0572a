"""Contract queries of the streaming jobs, run over the tables as bounded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.chunking import TOKEN_BUDGET
from tabularium.plans.contract import contract, read
from tabularium.plans.ingest import _TEXT_BLOCKS, _chunked
from tabularium.session import shared_path
from tabularium.sources.collection import collection
from tabularium.streaming.activity import event_time, streaming_rollup, streaming_sessions
from tabularium.streaming.ingest import IngestTarget, ingest_files, ingest_stream, manifest_table, stream_files


@contract(
    "stream_ingest",
    f"""WITH RECURSIVE {_TEXT_BLOCKS}, {_chunked(TOKEN_BUDGET)}
    SELECT d.source || '/' || d.doc_id AS source, md5(d.text) AS file_hash, count(*) AS chunks,
           sum(length(c.text))::BIGINT AS characters
    FROM chunks c JOIN documents d ON d.doc_id = c.id GROUP BY ALL""",
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive as files, changed ones a second time; the collection in the end."""
    folder = shared_path(spark, "files")
    files = read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "text", "lang")
    target = IngestTarget(shared_path(spark, "collection"), shared_path(spark, "manifest"))
    # First state: English texts in an older form, the rest as it is.
    older = F.when(F.col("lang") == "en", F.concat("text", F.lit("\nold line\n"), "text")).otherwise(F.col("text"))
    files.select("path", older.alias("text")).write.parquet(f"{folder}/in")
    query = ingest_stream(stream_files(spark, f"{folder}/in"), target, f"{folder}/checkpoint")
    query.awaitTermination()
    # Second state: all files are listed again, only the English ones differ.
    files.select("path", "text").write.mode("append").parquet(f"{folder}/in")
    query = ingest_stream(stream_files(spark, f"{folder}/in"), target, f"{folder}/checkpoint")
    query.awaitTermination()
    points = collection(spark, target.collection).read()
    return points.groupBy("source", F.col("fileHash").alias("file_hash")).agg(
        F.count("*").alias("chunks"), F.sum(F.length("text").cast("long")).alias("characters")
    )


@contract(
    "file_ingest",
    f"""WITH RECURSIVE {_TEXT_BLOCKS}, {_chunked(TOKEN_BUDGET)},
    made AS (SELECT id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY text)) AS digest FROM chunks GROUP BY id)
    SELECT source || '/' || doc_id || CASE lang WHEN 'es' THEN '.pdf' ELSE '.txt' END AS file_path, md5(d.text) AS file_hash,
      CASE lang WHEN 'es' THEN 0 ELSE coalesce(n, 0) END AS chunk_count, CASE WHEN lang <> 'es' THEN digest END AS digest,
      CASE lang WHEN 'es' THEN 'no parser for .pdf' END AS last_error
    FROM documents d LEFT JOIN made ON made.id = d.doc_id""",
)
def file_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Files of several kinds in one batch, some in two versions, some that cannot be parsed; manifest and chunks in the end."""
    documents = read(spark, sf, "documents")
    extension = F.when(F.col("lang") == "es", ".pdf").otherwise(".txt")
    now = documents.select(
        F.concat("source", F.lit("/"), "doc_id", extension).alias("path"), F.col("text").cast("binary").alias("content"),
        F.lit("2024-02-02 00:00:00").cast("timestamp").alias("modified_at"), "doc_id",
    )
    before = now.filter(F.col("doc_id") % 3 == 0).select(
        "path", F.concat(F.lit("older version of ").cast("binary"), F.col("content")).alias("content"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("modified_at"), "doc_id",
    )
    files = now.unionByName(before).select("path", "content", "modified_at", F.md5("content").alias("file_hash"), F.length("content").alias("file_size"))
    target = IngestTarget(shared_path(spark, "collection"), shared_path(spark, "manifest"))
    ingest_files(files, target)
    chunks = collection(spark, target.collection).read().groupBy(F.col("source").alias("file_path")).agg(
        F.md5(F.array_join(F.array_sort(F.collect_list("text")), "\n")).alias("digest")
    )
    manifest = manifest_table(spark, target.manifest).read()
    return manifest.join(chunks, "file_path", "left").select("file_path", "file_hash", "chunk_count", "digest", "last_error")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", event_time(F.col("ts")))


def _run(frame: DataFrame, name: str) -> DataFrame:
    folder = shared_path(frame.sparkSession, name)
    query = (
        frame.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return frame.sparkSession.read.parquet(f"{folder}/out")


@contract(
    "stream_rollup",
    """WITH hours AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total
                      FROM events GROUP BY ALL)
    SELECT hour, event_type, events, total FROM hours
    WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""",
)
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of a stream: every hour the watermark has closed."""
    rolled = streaming_rollup(_event_stream(spark, sf), "ts", "event_type", "value")
    return _run(rolled, "rollup").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@contract(
    "stream_sessions",
    """WITH marked AS (
      SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS opened
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT user_id, ts, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
    whole AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM numbered GROUP BY user_id, s)
    SELECT * FROM whole
    WHERE session_end + INTERVAL 600 SECONDS <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""",
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a stream: every session the watermark has closed."""
    closed = _run(streaming_sessions(_event_stream(spark, sf), "user_id", "ts"), "sessions")
    return closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
