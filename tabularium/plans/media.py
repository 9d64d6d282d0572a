"""Contract queries of image jobs. The test pages hold no images, so pages with
embedded ones are built from the documents' own bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.images import data_uri, extract_images, image_text, markers, resolve_markers
from tabularium.plans.contract import contract, read


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per document with its text as a PNG and its language as a GIF."""

    def tag(kind: str, data: Column) -> Column:
        return F.concat(F.lit(f'<p><IMG alt="x" src="data:image/{kind};base64,'), F.base64(data), F.lit('"></p>'))

    html = F.concat(
        tag("png", F.col("text").cast("binary")), F.lit("<img src='http://example.com/a.png'>"),
        tag("GIF", F.col("lang").cast("binary")),
    )
    return read(spark, sf, "documents").select("doc_id", F.md5("text").alias("file_hash"), html.alias("html"))


_IMAGES = """
images AS (
  SELECT doc_id, md5(text) AS file_hash, 0 AS picture_index, text AS body, 'image/png' AS mimetype FROM documents
  UNION ALL SELECT doc_id, md5(text), 1, lang, 'image/gif' FROM documents)"""


@contract(
    "image_extract",
    f"""WITH {_IMAGES} SELECT md5(file_hash || ':' || picture_index) AS id, file_hash, picture_index::INT AS picture_index,
    mimetype, md5(body) AS data_md5, strlen(body)::INT AS bytes FROM images""",
)
def image_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Images embedded in pages, numbered per page."""
    found = extract_images(_pages(spark, sf))
    return found.select(
        "id", "file_hash", "picture_index", "mimetype",
        F.md5("image_data").alias("data_md5"), F.octet_length("image_data").alias("bytes"),
    )


@contract(
    "image_uri",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'data:text/plain,' || doc_id WHEN 'fr' THEN NULL
    ELSE 'data:image/png;base64,' || to_base64(encode(text)) END AS uri FROM documents""",
)
def image_uri(spark: SparkSession, sf: str) -> DataFrame:
    """Data URIs from references and from bytes; neither gives none."""
    reference = F.when(F.col("lang") == "en", F.concat(F.lit("data:text/plain,"), "doc_id")).otherwise(F.lit("file.png"))
    data = F.when(F.col("lang") != "fr", F.col("text").cast("binary"))
    return read(spark, sf, "documents").select("doc_id", data_uri(reference, data).alias("uri"))


@contract(
    "image_text",
    """SELECT conv_id, turn, '[Image]' || CASE WHEN role = 'user' THEN chr(10) || '[Vision] ' || text ELSE '' END
    || CASE WHEN turn > 0 THEN chr(10) || '[Caption] ' || role ELSE '' END || chr(10) || '[Kontext] ' || turn AS text
    FROM conversations""",
)
def image_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Index text of images; parts that are absent or blank give no line."""
    vision = F.when(F.col("role") == "user", F.col("text"))
    caption = F.when(F.col("turn") > 0, F.col("role")).otherwise(F.lit("  "))
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", image_text(vision, caption, F.col("turn").cast("string")).alias("text")
    )


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with markers: own image, a shared one twice, one that nobody has."""
    mark = lambda name: F.concat(F.lit("[IMAGE:"), name, F.lit("]"))
    text = F.concat(
        mark(F.md5(F.col("doc_id").cast("string"))), F.lit(" start "), mark(F.col("source")), F.col("text"),
        mark(F.col("source")), mark(F.lit("nobody")), F.lit(" end"),
    )
    return read(spark, sf, "documents").select("doc_id", text.alias("text"))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of labelled documents and of every source."""
    own = read(spark, sf, "labels").select(F.md5(F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("u"), "doc_id").alias("uri"))
    shared = read(spark, sf, "documents").select(F.col("source").alias("id"), F.concat(F.lit("s:"), "source").alias("uri"))
    return own.unionByName(shared.distinct())


@contract(
    "image_resolve",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '[IMAGE:' || md5(d.doc_id::VARCHAR) || ']'
      ELSE '![' || md5(d.doc_id::VARCHAR) || '](u' || d.doc_id || ')' END || ' start ![' || source || '](s:' || source || ')'
      || text || '![' || source || '](s:' || source || ')[IMAGE:nobody] end' AS text
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def image_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Markers replaced by their images, in place; unknown ones stay."""
    return resolve_markers(_marked(spark, sf), _images(spark, sf), "doc_id")


@contract(
    "image_markers",
    """SELECT doc_id, md5(doc_id::VARCHAR) AS image_id FROM documents UNION ALL SELECT doc_id, source FROM documents
    UNION ALL SELECT doc_id, 'nobody' FROM documents""",
)
def image_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct markers of every text."""
    return markers(_marked(spark, sf), "doc_id")
