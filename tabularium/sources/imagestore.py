"""Images of documents on shared storage: bytes once per content, references beside them.

A reference says which picture of which file an image is. Bytes lie in a table of
their own, keyed by their hash, so that copies of a picture are stored once. How
many references a content has is counted when it is asked for, so that it cannot
go wrong; bytes whose last reference goes are removed.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.images import extract_images
from tabularium.sources.keyed import KeyedTable

REFERENCES = (
    "reference_id string, source string, id string, file_hash string, picture_index int, content_hash string, "
    "mimetype string, width int, height int, created_at timestamp"
)
CONTENTS = "content_hash string, image_data binary, bytes long"

# JPEG markers that start a frame and so tell the size.
_JPEG_FRAMES = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})


def size_of_image(data: bytes | None) -> tuple[int, int] | None:
    """Width and height by the headers of PNG, GIF, BMP and JPEG; None for anything else."""
    if not data or len(data) < 10:
        return None
    if data.startswith(b"\x89PNG\r\n\x1a\n") and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data.startswith(b"BM") and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            if data[at + 1] in _JPEG_FRAMES:
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_size(data: Column) -> Column:
    """``struct<width, height>`` of an image, null where its bytes do not tell."""

    @F.arrow_udf("struct<width:int,height:int>")
    def sizes(images: pa.Array) -> pa.Array:
        found = [size_of_image(one.as_buffer().to_pybytes() if one.is_valid else None) for one in images]
        # What does not fit is no size.
        fit = [s if s and max(s) < 1 << 31 else None for s in found]
        return pa.array([None if s is None else {"width": s[0], "height": s[1]} for s in fit], pa.struct([("width", pa.int32()), ("height", pa.int32())]))

    return sizes(data)


@dataclass(frozen=True)
class ImageStore:
    spark: SparkSession
    root: str

    @property
    def references(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/references", REFERENCES, ["reference_id", "source"]).create()

    @property
    def contents(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/contents", CONTENTS, ["content_hash"]).create()

    def add(self, pages: DataFrame) -> None:
        """Store the images embedded in ``pages(source, file_hash, html)``, one row per source.

        A source stored again loses the images it had; pictures that cannot be
        decoded are left out.
        """
        found = extract_images(pages, carry=["source"]).filter(F.col("image_data").isNotNull())
        rows = found.select(
            F.md5(F.concat_ws(":", "source", F.col("picture_index").cast("string"))).alias("reference_id"), "source", "id", "file_hash", "picture_index",
            F.sha2("image_data", 256).alias("content_hash"), "mimetype", image_size(F.col("image_data")).alias("size"), "image_data",
        )
        held = self.contents.read().select("content_hash")
        # The hash of the content is unique after the aggregation, however many copies there are.
        fresh = rows.groupBy("content_hash").agg(F.first("image_data").alias("image_data")).join(held, "content_hash", "left_anti")
        self.contents.upsert(fresh.withColumn("bytes", F.octet_length("image_data").cast("long")))
        kept = rows.select(
            "reference_id", "source", "id", "file_hash", "picture_index", "content_hash", "mimetype", F.col("size.width").alias("width"), F.col("size.height").alias("height"),
            F.current_timestamp().alias("created_at"),
        )
        self.references.upsert(kept, key="source", replaced=pages.select("source"))
        self.drop_unused()

    def counts(self) -> DataFrame:
        """``content_hash, references``."""
        return self.references.read().groupBy("content_hash").agg(F.count("*").alias("references"))

    def read(self) -> DataFrame:
        """All images with their bytes, one row per reference."""
        return self.references.read().join(self.contents.read(), "content_hash")

    def drop_unused(self) -> None:
        """Drop contents without references."""
        used = self.references.read().select("content_hash").distinct()
        unused = self.contents.read().select("content_hash").join(used, "content_hash", "left_anti")
        self.contents.delete("content_hash", unused)

    def erase(self, sources: DataFrame) -> None:
        """Drop the images of ``sources(source)``, and the bytes that nobody else refers to, from storage."""
        self.references.delete("source", sources)
        self.drop_unused()
        for table in (self.references, self.contents):
            table.compact()
            table.forget()
