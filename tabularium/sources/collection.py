"""Collections of points: dense and sparse vectors, text and payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.payload import payload, point_id, without_text
from tabularium.functions.vectors import has_dimension
from tabularium.operators.dense import Embedder
from tabularium.operators.sparse import sparse_encoder
from tabularium.sources.keyed import KeyedTable

# Payload keys kept as columns of their own, so that filters on them reach the scan.
INDEXED = ("source", "fileHash", "fileSize", "contentType")

POINT = (
    "id string, text string, dense array<float>, terms array<string>, tfs array<int>, length int, "
    "source string, fileHash string, fileSize string, contentType string, payload string"
)


def collection(spark: SparkSession, root: str) -> KeyedTable:
    """The collection below ``root``, created if there is none. Points are
    replaced by id, or by source when a whole file changes."""
    return KeyedTable(spark, root, POINT, ["id", "source"]).create()


def build_points(documents: DataFrame, embedder: Embedder) -> DataFrame:
    """Points of ``documents(id, text, metadata)``: both vectors and the payload.

    A missing id is derived from source and text. Nothing is shuffled.
    """
    metadata = without_text(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    identified = documents.select(
        point_id(F.col("id").cast("string"), F.try_element_at(metadata, F.lit("source")), F.col("text")).alias("id"),
        "text",
        metadata.alias("metadata"),
    )
    text = F.col("text")
    # Both vectors in one step: with the built-in embedder one Python worker of a task gets the tokens once, not two workers once each.
    encoded = identified.select("id", "text", "metadata", sparse_encoder()(text).alias("_sparse"), embedder(text).alias("dense"))
    return encoded.select(
        "id",
        "text",
        "dense",
        "_sparse.terms",
        "_sparse.tfs",
        "_sparse.length",
        *[F.try_element_at("metadata", F.lit(key)).alias(key) for key in INDEXED],
        payload(text, F.col("metadata")).alias("payload"),
    )


def checked(points: DataFrame, dimension: int) -> DataFrame:
    """Points as they are; one with a dense vector of another dimension stops
    the job, as it would make the collection unsearchable."""
    wrong = F.raise_error(F.lit(f"a dense vector does not have {dimension} dimensions"))
    return points.withColumn("dense", F.when(has_dimension(F.col("dense"), dimension), F.col("dense")).otherwise(wrong))
