"""Contract queries of parsing, chunking and the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once
from tabularium.functions.markup import html_blocks, text_blocks
from tabularium.functions.payload import matches, payload, point_id
from tabularium.operators.chunking import TOKEN_BUDGET, chunk, export_documents
from tabularium.operators.dense import hashing_embedder
from tabularium.operators.upsert import keyed_upsert, upsert_counts
from tabularium.plans.contract import contract, read
from tabularium.plans.retrieval import DIMENSION
from tabularium.session import shared_path
from tabularium.sources.collection import build_points, checked
from tabularium.sources.documents import parse_documents
from tabularium.sources.keyed import KeyedTable

# Small budgets that make sentences and windows of words necessary.
SMALL_BUDGET = 24
HTML_BUDGET = 64

_SPACE = r"[ \x09-\x0D\x1C-\x1F\x85\p{Z}]+"


def _count(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '{_SPACE}'), lambda w: w <> ''))"


_TEXT_BLOCKS = rf"""
pg AS (SELECT doc_id AS id, unnest(string_split(text, chr(12))) AS body,
              generate_subscripts(string_split(text, chr(12)), 1) AS page FROM documents),
ln AS (SELECT id, page, unnest(string_split(body, chr(10))) AS raw,
              generate_subscripts(string_split(body, chr(10)), 1) AS line FROM pg),
st AS (SELECT id, page, line, regexp_replace(regexp_replace(raw, '^{_SPACE}', ''), '{_SPACE}$', '') AS text FROM ln),
blocks AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY page, line) - 1 AS block, page, '' AS headings, text
           FROM st WHERE text <> '')"""

_SILENT = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>"
    r"|<noscript\b[^>]*>.*?</noscript\s*>|<!doctype[^>]*>|<head\b[^>]*>.*?</head\s*>"
)
_BLOCK_TAGS = (
    r"(?i)</?(address|article|aside|blockquote|body|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer"
    r"|form|header|hr|html|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
)


def _html_marked() -> str:
    sql = "regexp_replace(html, '[\\x01\\x02]', ' ', 'g')"
    sql = f"regexp_replace({sql}, '{_SILENT}', ' ', 'g')"
    sql = rf"regexp_replace({sql}, '(?i)<h([1-6])\b[^>]*>', chr(1) || '\1' || chr(2), 'g')"
    sql = rf"regexp_replace({sql}, '(?i)</h[1-6]\s*>', chr(1), 'g')"
    sql = f"regexp_replace({sql}, '{_BLOCK_TAGS}', chr(1), 'g')"
    sql = f"regexp_replace({sql}, '<[^>]*>', ' ', 'g')"
    for entity, plain in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
        ("&amp;", "&"),
    ):
        sql = f"replace({sql}, '{entity}', '{plain}')"
    return f"regexp_replace({sql}, '{_SPACE}', ' ', 'g')"


_HTML_BLOCKS = rf"""
mk AS (SELECT page_id AS id, string_split({_html_marked()}, chr(1)) AS parts FROM pages),
pt AS (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM mk),
hd AS (SELECT id, i, substr(part, 1, 1)::INT AS level, trim(substr(part, 3)) AS title
       FROM pt WHERE regexp_matches(part, '^[1-6]\x02')),
hn AS (SELECT h.id, h.i, h.title, coalesce(min(k.i), 1000000000) AS until
       FROM hd h LEFT JOIN hd k ON k.id = h.id AND k.i > h.i AND k.level <= h.level GROUP BY h.id, h.i, h.title),
tx AS (SELECT id, i, trim(part) AS text FROM pt WHERE NOT regexp_matches(part, '^[1-6]\x02') AND trim(part) <> ''),
blocks AS (
  SELECT t.id, row_number() OVER (PARTITION BY t.id ORDER BY t.i) - 1 AS block, NULL::BIGINT AS page,
         coalesce((SELECT string_agg(h.title, chr(10) ORDER BY h.i) FROM hn h
                   WHERE h.id = t.id AND h.i < t.i AND t.i < h.until AND h.title <> ''), '') AS headings, t.text
  FROM tx t)"""


def _chunked(budget: int) -> str:
    """Tables ``walk`` and ``chunks`` from ``blocks(id, block, page, headings, text)``."""
    return rf"""
sized AS (SELECT *, {_count('text')} AS size FROM blocks),
sent AS (SELECT id, block, page, headings,
                unnest(string_split(regexp_replace(text, '([.!?]){_SPACE}', '\1' || chr(1), 'g'), chr(1))) AS text,
                generate_subscripts(string_split(regexp_replace(text, '([.!?]){_SPACE}', '\1' || chr(1), 'g'), chr(1)), 1) AS s
         FROM sized WHERE size > {budget}),
sents AS (SELECT *, {_count('text')} AS size FROM sent),
win AS (SELECT id, block, page, headings, s, unnest(range(0, ceil(size / {budget})::BIGINT)) AS w, size,
               list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') AS ws
        FROM sents WHERE size > {budget}),
pieces AS (
  SELECT id, block, page, headings, 0 AS s, 0 AS w, text, size FROM sized WHERE size <= {budget}
  UNION ALL SELECT id, block, page, headings, s, 0, text, size FROM sents WHERE size BETWEEN 1 AND {budget}
  UNION ALL SELECT id, block, page, headings, s, w, array_to_string(ws[w * {budget} + 1 : (w + 1) * {budget}], ' '),
                   least({budget}, size - w * {budget}) FROM win),
p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY block, s, w) AS n FROM pieces),
walk AS (
  SELECT id, n, size AS fill, 0 AS chunk, headings FROM p WHERE n = 1
  UNION ALL
  SELECT p.id, p.n,
         CASE WHEN w.headings <> p.headings OR w.fill + p.size > {budget} THEN p.size ELSE w.fill + p.size END,
         w.chunk + CASE WHEN w.headings <> p.headings OR w.fill + p.size > {budget} THEN 1 ELSE 0 END, p.headings
  FROM walk w JOIN p ON p.id = w.id AND p.n = w.n + 1),
chunks AS (
  SELECT p.id, walk.chunk AS chunk_index, min(p.headings) AS headings,
         CASE WHEN min(p.headings) = '' THEN '' ELSE min(p.headings) || chr(10) END
           || string_agg(p.text, chr(10) ORDER BY p.n) AS text,
         string_agg(p.text, chr(10) ORDER BY p.n) AS raw_text,
         sum(p.size) AS num_tokens, list_sort(list(DISTINCT p.block)) AS doc_blocks, list_sort(list(DISTINCT p.page)) AS pages
  FROM p JOIN walk ON walk.id = p.id AND walk.n = p.n GROUP BY p.id, walk.chunk)"""


def text_documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("path"), text_blocks(F.col("text")).alias("blocks")
    )


# Characters that the pages get written as references; the SQL reads the pages as they are.
_REFERENCES = (("é", "&eacute;"), ("ö", "&#246;"), ("ñ", "&#xF1;"), ("ç", "&#Xe7;"), ("ß", "&szlig;"), ("ü", "&uuml;"), ("ó", "&#0243;"))


def html_documents(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    for character, reference in _REFERENCES:
        html = F.replace(html, F.lit(character), F.lit(reference))
    return read(spark, sf, "pages").select(
        "page_id", F.col("page_id").cast("string").alias("path"), html_blocks(html).alias("blocks")
    )


def _flat(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.col("path").cast("long").alias("id"),
        "chunk_index",
        "text",
        "num_tokens",
        F.coalesce(F.array_join("headings", "\n"), F.lit("")).alias("headings"),
        F.array_join("doc_items", ",").alias("doc_items"),
        F.array_join("page_numbers", ",").alias("page_numbers"),
    )


_FLAT = r"""SELECT id, chunk_index::INT AS chunk_index, text, num_tokens::INT AS num_tokens, headings,
    array_to_string(list_transform(doc_blocks, lambda b: '#/texts/' || b), ',') AS doc_items,
    {pages} AS page_numbers FROM chunks"""


@contract(
    "chunk_text",
    f"WITH RECURSIVE {_TEXT_BLOCKS}, {_chunked(TOKEN_BUDGET)} "
    + _FLAT.format(pages="array_to_string(pages, ',')"),
)
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut in chunks of the default budget, whole texts."""
    return _flat(chunk(text_documents(spark, sf)))


@contract(
    "chunk_stats",
    f"""WITH RECURSIVE {_TEXT_BLOCKS}, {_chunked(SMALL_BUDGET)}
    SELECT id, count(*) AS chunks, sum(num_tokens)::BIGINT AS tokens, max(num_tokens)::INT AS largest,
           md5(string_agg(raw_text, chr(10) ORDER BY chunk_index)) AS digest FROM chunks GROUP BY id""",
)
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A small budget, so that lines are cut at sentences and between words;
    the digest covers the whole text of all chunks in order."""
    chunks = chunk(text_documents(spark, sf), SMALL_BUDGET, include_raw_text=True)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "raw_text")))
    return chunks.groupBy(F.col("path").cast("long").alias("id")).agg(
        F.count("*").alias("chunks"),
        F.sum("num_tokens").alias("tokens"),
        F.max("num_tokens").alias("largest"),
        F.md5(F.array_join(F.transform(ordered, lambda c: c["raw_text"]), "\n")).alias("digest"),
    )


@contract(
    "chunk_html",
    f"WITH RECURSIVE {_HTML_BLOCKS}, {_chunked(HTML_BUDGET)} " + _FLAT.format(pages="NULL::VARCHAR"),
)
def chunk_html(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages cut in chunks under their headings."""
    return _flat(chunk(html_documents(spark, sf), HTML_BUDGET))


@contract(
    "page_blocks",
    f"WITH {_HTML_BLOCKS} SELECT id, block::INT AS block, headings, text FROM blocks",
)
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered blocks of every web page with their heading path."""
    pages = html_documents(spark, sf)
    return explode_once(pages, F.col("blocks"), "b", "block").select(
        F.col("page_id").alias("id"), "block", F.array_join("b.headings", "\n").alias("headings"), "b.text"
    )


@contract(
    "document_export",
    f"""WITH {_TEXT_BLOCKS},
    counted AS (SELECT id, count(*) AS n, min_by(text, block) AS first_text FROM blocks GROUP BY id)
    SELECT d.doc_id AS id, 'ExportResult' AS kind, d.doc_id::VARCHAR AS filename, 'success' AS status,
           0 AS errors, coalesce(c.n, 0)::INT AS texts, c.first_text
    FROM documents d LEFT JOIN counted c ON c.id = d.doc_id""",
)
def document_export(spark: SparkSession, sf: str) -> DataFrame:
    """Converted documents as nested JSON, read back field by field."""
    exported = export_documents(text_documents(spark, sf))
    content = F.from_json("content.json_content", "struct<texts:array<struct<text:string>>>")
    return exported.select(
        F.col("path").cast("long").alias("id"),
        "kind",
        "content.filename",
        "status",
        F.size("errors").alias("errors"),
        F.size(content["texts"]).alias("texts"),
        F.try_element_at(content["texts"], F.lit(1))["text"].alias("first_text"),
    )


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of three kinds: English plain text, French Markdown, others in a
    format without a built-in parser, and all web pages."""
    extension = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".md").otherwise(".pdf")
    texts = read(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "doc_id", extension).alias("path"), F.col("text").cast("binary").alias("content")
    )
    pages = read(spark, sf, "pages").select(
        F.concat(F.lit("web/"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content")
    )
    return texts.unionByName(pages).select(
        "path", F.md5("content").alias("file_hash"), F.octet_length("content").cast("long").alias("file_size"), "content"
    )


@contract(
    "parse_files",
    rf"""WITH {_TEXT_BLOCKS.replace("blocks AS", "tblocks AS")}, {_HTML_BLOCKS},
    nt AS (SELECT id, count(*) AS n FROM tblocks GROUP BY id), nh AS (SELECT id, count(*) AS n FROM blocks GROUP BY id)
    SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' ELSE '.pdf' END AS path,
           md5(text) AS file_hash, strlen(text) AS file_size,
           CASE WHEN lang IN ('en', 'fr') THEN coalesce(nt.n, 0) ELSE 0 END::INT AS blocks,
           CASE WHEN lang IN ('en', 'fr') THEN '' ELSE 'no parser for .pdf' END AS error
    FROM documents LEFT JOIN nt ON nt.id = doc_id
    UNION ALL
    SELECT 'web/' || page_id || '.html', md5(html), strlen(html), coalesce(nh.n, 0)::INT, ''
    FROM pages LEFT JOIN nh ON nh.id = page_id""",
)
def parse_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of several formats to blocks; an unknown format is an error record."""
    return parse_documents(_files(spark, sf)).select(
        "path",
        "file_hash",
        "file_size",
        F.size("blocks").alias("blocks"),
        F.array_join(F.transform("errors", lambda e: e["error_message"]), "; ").alias("error"),
    )


# Collection ------------------------------------------------------------------


def _documents_as_items(spark: SparkSession, sf: str) -> DataFrame:
    """Document items ``id, text, metadata``."""
    meta = F.create_map(
        F.lit("source"), F.col("source"),
        F.lit("fileHash"), F.md5("text"),
        F.lit("fileSize"), F.col("n_chars").cast("string"),
        F.lit("contentType"), F.col("lang"),
        F.lit("text"), F.lit("not the text"),
    )
    documents = read(spark, sf, "documents")
    return documents.select(F.col("doc_id").cast("string").alias("id"), "text", meta.alias("metadata"))


@contract(
    "build_points",
    rf"""WITH d AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
    s AS (SELECT id, count(DISTINCT term)::INT AS terms, count(*)::INT AS length FROM d GROUP BY id)
    SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, {DIMENSION} AS dimension, coalesce(terms, 0) AS terms,
           coalesce(length, 0) AS length, source, md5(text) AS "fileHash", n_chars::VARCHAR AS "fileSize",
           lang AS "contentType", md5(text) AS payload_text_md5, source AS payload_source
    FROM documents LEFT JOIN s ON s.id = doc_id""",
)
def points(spark: SparkSession, sf: str) -> DataFrame:
    """Points as stored: both vectors, indexed keys, payload without a stray text key."""
    built = checked(build_points(_documents_as_items(spark, sf), hashing_embedder(DIMENSION)), DIMENSION)
    parsed = F.from_json("payload", "map<string,string>")
    return built.select(
        "id",
        F.md5("text").alias("text_md5"),
        F.size("dense").alias("dimension"),
        F.size("terms").alias("terms"),
        "length",
        "source",
        "fileHash",
        "fileSize",
        "contentType",
        F.md5(parsed["text"]).alias("payload_text_md5"),
        parsed["source"].alias("payload_source"),
    )


def _incoming(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping batches of new versions, and rows with new ids."""
    documents = read(spark, sf, "documents").select("doc_id", "text", "source")
    labels = read(spark, sf, "labels")
    pages = read(spark, sf, "pages")
    labelled = documents.join(labels, "doc_id")
    first = labelled.select("doc_id", F.concat("text", F.lit("!")).alias("text"), "source", F.lit(1).alias("batch"))
    second = labelled.filter(F.col("quality") == 1).select(
        "doc_id", F.md5("text").alias("text"), "source", F.lit(2).alias("batch")
    )
    new = pages.select((-F.col("page_id") - 1).alias("doc_id"), F.col("url").alias("text"), F.lit("web").alias("source"), F.lit(1).alias("batch"))
    return first.unionByName(second).unionByName(new)


_INCOMING = """
labelled AS (SELECT d.doc_id, d.text, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)),
incoming AS (
  SELECT doc_id, text || '!' AS text, source, 1 AS batch FROM labelled
  UNION ALL SELECT doc_id, md5(text), source, 2 FROM labelled WHERE quality = 1
  UNION ALL SELECT -page_id - 1, url, 'web', 1 FROM pages),
newest AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) = 1)"""


@contract(
    "collection_upsert",
    f"""WITH {_INCOMING}, merged AS (
      SELECT doc_id, text, source FROM newest
      UNION ALL SELECT doc_id, text, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM newest))
    SELECT doc_id AS id, md5(text) AS text_md5, source FROM merged""",
)
def collection_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Insert or replace by id; the newest batch of an id wins."""
    existing = read(spark, sf, "documents").select("doc_id", "text", "source")
    merged = keyed_upsert(existing, _incoming(spark, sf), ["doc_id"], [F.desc("batch")])
    return merged.select(F.col("doc_id").alias("id"), F.md5("text").alias("text_md5"), "source")


@contract(
    "upsert_reply",
    f"WITH {_INCOMING} SELECT count(*) AS submitted, count(DISTINCT doc_id) AS distinct_ids FROM incoming",
)
def upsert_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Rows handed in and distinct ids among them."""
    return upsert_counts(_incoming(spark, sf), ["doc_id"])


@contract(
    "keyed_table",
    f"""WITH {_INCOMING}, merged AS (
      SELECT doc_id, text, source FROM newest
      UNION ALL SELECT doc_id, text, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM newest))
    SELECT doc_id AS id, md5(text) AS text_md5, source FROM merged
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def keyed_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same on stored tables: base, two batches, a delete, a compaction."""
    schema = "doc_id long, text string, source string"
    table = KeyedTable(spark, shared_path(spark, "points"), schema, ["doc_id", "source"]).create()
    table.upsert(read(spark, sf, "documents").select("doc_id", "text", "source"))
    table.upsert(_incoming(spark, sf), order=[F.desc("batch")])
    table.delete("doc_id", read(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id"))
    table.compact()
    return table.read().select(F.col("doc_id").alias("id"), F.md5("text").alias("text_md5"), "source")


@contract(
    "point_ids",
    r"""WITH keyed AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'q-' || conv_id || '-' || turn END AS given,
                              md5(conv_id || chr(31) || turn) AS digest FROM conversations)
    SELECT conv_id, turn, coalesce(given, regexp_replace(digest, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')) AS id
    FROM keyed""",
)
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids as given, or stable ones shaped like a UUID."""
    given = F.when(F.col("role") == "user", F.concat_ws("-", F.lit("q"), F.col("conv_id"), F.col("turn")))
    made = point_id(given, F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return read(spark, sf, "conversations").select("conv_id", "turn", made.alias("id"))


@contract(
    "payload_filter",
    """SELECT doc_id::VARCHAR AS id, n_chars::VARCHAR AS size FROM documents WHERE source = 'src1' AND lang = 'en'""",
)
def payload_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Points whose payload has two given values."""
    items = _documents_as_items(spark, sf).withColumn("payload", payload(F.col("text"), F.col("metadata")))
    return items.filter(matches(F.col("payload"), source="src1", contentType="en")).select(
        "id", F.get_json_object("payload", "$.fileSize").alias("size")
    )
