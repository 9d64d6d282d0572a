"""Images of documents: extraction, data URIs, index text, marker resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once

_DATA_IMAGE = r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["'](data:image/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=\s]+)["']"""
MARKER = r"\[IMAGE:([^\]\s]+)\]"

# Type used for bytes that do not say what they are.
DEFAULT_MIMETYPE = "image/png"


def extract_images(pages: DataFrame, html_col: str = "html", hash_col: str = "file_hash", carry: Sequence[str] = ()) -> DataFrame:
    """``id, file_hash, picture_index, image_data, mimetype`` for images embedded
    as data URIs, numbered from 0 in page order, and the columns to ``carry``. Stays inside the row."""
    uris = F.regexp_extract_all(F.col(html_col), F.lit(_DATA_IMAGE), F.lit(1))
    found = explode_once(pages.select(F.col(hash_col).alias("file_hash"), F.col(html_col), *carry), uris, "_uri", "picture_index")
    body = F.regexp_replace(F.substring_index("_uri", ",", -1), r"\s", "")
    return found.select(
        F.md5(F.concat_ws(":", "file_hash", F.col("picture_index").cast("string"))).alias("id"),
        "file_hash",
        "picture_index",
        F.try_to_binary(body, F.lit("base64")).alias("image_data"),
        F.lower(F.regexp_extract("_uri", r"(?i)\Adata:([^;]+);", 1)).alias("mimetype"),
        *carry,
    )


def data_uri(reference: Column, data: Column, mimetype: Column | None = None) -> Column:
    """A ``data:`` reference as it is, otherwise one made from the bytes, or null.

    ``base64`` of Spark breaks long lines; a URI must not.
    """
    kind = F.coalesce(mimetype, F.lit(DEFAULT_MIMETYPE)) if mimetype is not None else F.lit(DEFAULT_MIMETYPE)
    encoded = F.regexp_replace(F.base64(data), r"\s", "")
    made = F.concat(F.lit("data:"), kind, F.lit(";base64,"), encoded)
    return F.when(reference.startswith("data:"), reference).otherwise(made)


def image_text(vision: Column, caption: Column, context: Column) -> Column:
    """Text under which an image is indexed; absent parts give no line."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.concat(F.lit(f"[{label}] "), F.trim(value)))

    return F.concat_ws("\n", F.lit("[Image]"), line("Vision", vision), line("Caption", caption), line("Kontext", context))


def markers(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``key, image_id``, one row per distinct marker of a text."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(MARKER), F.lit(1)))
    return explode_once(texts.select(key, text_col), ids, "image_id").drop(text_col)


def salted(pairs: DataFrame, key: str, id_col: str = "image_id", shares: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``pairs(key, id)`` with a ``salt``, and ``id, salts`` of the hot ids: those with more than an even share of all pairs.

    An id with n shares is spread over n salts by the key. There are fewer hot ids
    than ``shares``, whatever the data are, so their list can be broadcast.
    """
    spark = pairs.sparkSession
    shares = shares or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counted = pairs.groupBy(id_col).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    hot = counted.filter(F.col("n") * shares > total).select(id_col, F.ceil(F.col("n") * shares / F.lit(max(total, 1))).cast("int").alias("salts"))
    # At most ``shares`` rows.
    hot = spark.createDataFrame(hot.collect(), hot.schema)
    salt = F.pmod(F.xxhash64(key), F.coalesce("salts", F.lit(1))).cast("int")
    return pairs.join(F.broadcast(hot), id_col, "left").withColumn("salt", salt).drop("salts"), hot


def resolve_markers(texts: DataFrame, images: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replace ``[IMAGE:id]`` by a Markdown image; unknown ids keep their marker.

    ``images`` is ``(id, uri)``. Ids are matched once per distinct id of a text, and
    the pairs of an id that many texts have are spread over several tasks, each with a
    copy of that image's URI. The text itself travels only in the final join, and is
    rebuilt in order.
    """
    pairs, hot = salted(markers(texts, key, text_col), key)
    # Equal files give equal ids: one row per id.
    wanted = images.filter(F.col("uri").isNotNull()).select(F.col("id").alias("image_id"), "uri")
    known = wanted.groupBy("image_id").agg(F.min("uri").alias("uri")).join(F.broadcast(hot), "image_id", "left")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    resolved = pairs.join(known, ["image_id", "salt"])
    known = resolved.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("image_id", "uri"))).alias("_uris"))
    joined = texts.join(known, key, "left")
    parts = F.split(F.col(text_col), r"(?=\[IMAGE:)")
    rebuilt = F.transform(
        parts,
        lambda part: F.coalesce(
            F.concat(
                F.lit("!["),
                F.regexp_extract(part, MARKER, 1),
                F.lit("]("),
                F.try_element_at("_uris", F.regexp_extract(part, MARKER, 1)),
                F.lit(")"),
                F.regexp_replace(part, r"\A" + MARKER, ""),
            ),
            part,
        ),
    )
    return joined.withColumn(
        text_col, F.when(F.col("_uris").isNull(), F.col(text_col)).otherwise(F.array_join(rebuilt, ""))
    ).drop("_uris")
