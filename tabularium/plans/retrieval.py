"""Contract queries of the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once
from tabularium.functions.text import tokens, words
from tabularium.functions.vectors import cosine, norm
from tabularium.operators.cells import assign_cells, cell_top_k, measure_cells, train_centres, write_cells
from tabularium.operators.centretree import assign_leaves, leaf_top_k, pairs_scored, recall, train_tree, write_leaves
from tabularium.operators.context import assemble, document_citation
from tabularium.operators.dense import dense_top_k, hashing_embedder
from tabularium.operators.fusion import fuse, union_legs
from tabularium.operators.postings import postings_top_k, write_postings
from tabularium.operators.ranking import top_k
from tabularium.operators.rerank import apply_ranker_reply, rerank
from tabularium.operators.routing import route
from tabularium.operators.search import SearchOptions, hybrid_search, retrieve, sparse_input, with_texts
from tabularium.operators.sparse import corpus_stats, document_frequency, idf, sparse_top_k, sparse_vectors, term_weights
from tabularium.plans.contract import ORACLES, contract, read
from tabularium.session import shared_path
from tabularium.sources.collection import build_points, checked, collection
from tabularium.workspace import Workspace

DIMENSION = 64
# Words of at least this many letters serve as keywords of a question.
KEYWORD_LETTERS = 9

_TOKEN = r"[\p{L}\p{N}]+"
_SPACE = r"[ \x09-\x0D\x1C-\x1F\x85\p{Z}]+"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# Shared SQL blocks -----------------------------------------------------------

_INDEX = rf"""
d AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM d GROUP BY id, term),
len AS (SELECT id, sum(tf) AS len FROM tf GROUP BY id),
tot AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM len) AS total),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _bm25(asked: str, limit: int) -> str:
    """Tables ``bm`` (all scores) and ``sparse`` (best per query) from ``asked(query_id, query)``."""
    return rf"""
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '{_TOKEN}')) AS term FROM {asked}),
bm AS (
  SELECT q.query_id, tf.id,
         round(sum(ln(1 + (tot.n - df.df + 0.5) / (df.df + 0.5)) *
                   tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.len / (tot.total / tot.n)))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.id = tf.id CROSS JOIN tot
  GROUP BY q.query_id, tf.id),
sparse AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM bm QUALIFY rank <= {limit})"""


def _embedded(name: str, table: str, key: str, text: str) -> str:
    """Table ``name(id, dim, value)`` with the hashing embedding in long form."""
    return rf"""
{name}_t AS (SELECT {key} AS id, md5(unnest(regexp_extract_all(lower({text}), '{_TOKEN}'))) AS h FROM {table}),
{name}_s AS (
  SELECT id, ('0x' || substr(h, 1, 6))::BIGINT % {DIMENSION} AS dim,
         sum(CASE WHEN substr(h, 7, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
  FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY id),
{name} AS (
  SELECT s.id, s.dim, CASE WHEN n.norm > 0 THEN (s.v / n.norm)::FLOAT::DOUBLE ELSE 0 END AS value
  FROM {name}_s s JOIN {name}_n n USING (id))"""


def _dense(limit: int) -> str:
    """Table ``dense`` from long embeddings ``de`` (documents) and ``qe`` (questions)."""
    return f"""
de_l AS (SELECT id, sqrt(sum(value * value)) AS norm FROM de GROUP BY id),
qe_l AS (SELECT id, sqrt(sum(value * value)) AS norm FROM qe GROUP BY id),
dots AS (SELECT qe.id AS query_id, de.id, sum(qe.value * de.value) AS dot FROM qe JOIN de USING (dim) GROUP BY ALL),
every AS (SELECT b.item_id AS query_id, t.doc_id AS id FROM benchmark b CROSS JOIN documents t),
cosines AS (
  SELECT e.query_id, e.id, round(CASE WHEN d.norm > 0 AND q.norm > 0 THEN coalesce(x.dot, 0) / (d.norm * q.norm)
                                      ELSE 0 END, 6) AS score
  FROM every e LEFT JOIN dots x USING (query_id, id)
  LEFT JOIN de_l d ON d.id = e.id LEFT JOIN qe_l q ON q.id = e.query_id),
dense AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM cosines QUALIFY rank <= {limit})"""


def _fused(limit: int, threshold: float | None = None) -> str:
    cut = "" if threshold is None else f"WHERE score >= {threshold}"
    return f"""
legs AS (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM sparse),
summed AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM legs GROUP BY ALL),
fused AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM summed {cut} QUALIFY rank <= {limit})"""


def _words(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '{_SPACE}'), lambda w: w <> ''))"


def _reranked(source: str, limit: int) -> str:
    """Table ``reranked`` from ``source(query_id, id, rank)``."""
    return rf"""
pairs AS (
  SELECT c.query_id, c.id, c.rank AS first_rank, {_words('b.text')} AS qw, {_words('t.text')} AS dw
  FROM {source} c JOIN benchmark b ON b.item_id = c.query_id JOIN documents t ON t.doc_id = c.id),
shared AS (
  SELECT query_id, id, first_rank, round(len(list_intersect(qw, dw))::DOUBLE / greatest(len(qw), 1), 6) AS score
  FROM pairs),
reranked AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank
  FROM shared QUALIFY rank <= {limit})"""


_ASKED = "(SELECT item_id AS query_id, text AS query FROM benchmark)"
_EMBEDDINGS = _embedded("de", "documents", "doc_id", "text") + "," + _embedded("qe", "benchmark", "item_id", "text")


# Sparse leg ------------------------------------------------------------------


@contract(
    "bm25_topk",
    f"WITH {_INDEX}, {_bm25(_ASKED, 10)} SELECT query_id, id, score, rank::INT AS rank FROM sparse",
)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Best ten documents per question by BM25."""
    return sparse_top_k(corpus(spark, sf), questions(spark, sf), 10)


@contract(
    "bm25_keywords",
    rf"""WITH words AS (
  SELECT item_id, text,
         list_filter(string_split_regex(text, '{_SPACE}'), lambda w: length(w) >= {KEYWORD_LETTERS}) AS kw
  FROM benchmark),
asked AS (
  SELECT item_id AS query_id, CASE WHEN len(kw) > 0 THEN array_to_string(kw, ' ') ELSE text END AS query FROM words),
{_INDEX}, {_bm25("asked", 10)} SELECT query_id, id, score, rank::INT AS rank FROM sparse""",
)
def bm25_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse leg asked by keywords; a question without any is asked in full."""
    long_words = F.filter(words(F.col("query")), lambda w: F.length(w) >= KEYWORD_LETTERS)
    asked = questions(spark, sf).withColumn("keywords", long_words)
    return sparse_top_k(corpus(spark, sf), sparse_input(asked), 10)


@contract(
    "term_stats",
    f"""WITH {_INDEX} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN tot""",
)
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and idf of every term."""
    texts = corpus(spark, sf)
    documents = texts.count()
    return document_frequency(texts).select("term", "df", F.round(idf(F.col("df"), F.lit(documents)), 6).alias("idf"))


@contract(
    "sparse_encode",
    f"""WITH {_INDEX} SELECT id, count(*)::INT AS terms, sum(tf)::INT AS length, max(tf)::INT AS max_tf,
    min(term) AS first_term FROM tf GROUP BY id""",
)
def sparse_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse vectors as stored with points, summed up per document."""
    return (
        sparse_vectors(corpus(spark, sf))
        .filter(F.col("length") > 0)
        .select(
            "id",
            F.size("terms").alias("terms"),
            "length",
            F.array_max("tfs").alias("max_tf"),
            F.array_min("terms").alias("first_term"),
        )
    )


@contract(
    "sparse_weights",
    f"""WITH {_INDEX} SELECT tf.id, term,
    round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (tot.total / tot.n))), 6) AS weight
    FROM tf JOIN len USING (id) CROSS JOIN tot""",
)
def sparse_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Length-normalised weight of every term of every document."""
    return term_weights(corpus(spark, sf)).select("id", "term", F.round("weight", 6).alias("weight"))


# Dense leg -------------------------------------------------------------------


def label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of every label, ``query_id, dense``: one hash aggregation with
    a mean per dimension, so a label that holds most vectors is no hot group."""
    vectors = read(spark, sf, "embeddings")
    means = vectors.groupBy(F.col("label").alias("query_id")).agg(
        *[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(DIMENSION)]
    )
    return means.select("query_id", F.array(*[f"m{i}" for i in range(DIMENSION)]).alias("dense"))


_CENTRES = """
cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS dim
          FROM embeddings),
centres AS (SELECT label AS query_id, dim, avg(value) AS value FROM cells GROUP BY ALL),
centre_l AS (SELECT query_id, sqrt(sum(value * value)) AS norm FROM centres GROUP BY query_id),
vec_l AS (SELECT vec_id, sqrt(sum(value * value)) AS norm FROM cells GROUP BY vec_id),
cosines AS (
  SELECT c.query_id, v.vec_id AS id, round(sum(c.value * v.value) / max(cl.norm * vl.norm), 6) AS score
  FROM centres c JOIN cells v USING (dim) JOIN centre_l cl ON cl.query_id = c.query_id
  JOIN vec_l vl ON vl.vec_id = v.vec_id GROUP BY ALL),
best AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM cosines QUALIFY rank <= 10)"""


@contract("dense_topk", f"WITH {_CENTRES} SELECT query_id, id, score, rank::INT AS rank FROM best")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest ten vectors, by cosine, to the centre of every label."""
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return dense_top_k(vectors, label_centres(spark, sf), 10, DIMENSION)


@contract("dense_topk_blocks", f"WITH {_CENTRES} SELECT query_id, id, score, rank::INT AS rank FROM best")
def dense_topk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same nearest vectors where the queries come in several blocks, all of which meet the corpus in one scan."""
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return dense_top_k(vectors, label_centres(spark, sf), 10, DIMENSION, cells_per_block=2 * DIMENSION)


@contract(
    "vector_scores",
    f"""WITH {_CENTRES} SELECT v.vec_id AS id, v.label, round(max(vl.norm), 6) AS norm,
    round(sum(c.value * v.value) / max(cl.norm * vl.norm), 6) AS cosine
    FROM cells v JOIN centres c ON c.query_id = v.label AND c.dim = v.dim JOIN centre_l cl ON cl.query_id = v.label
    JOIN vec_l vl ON vl.vec_id = v.vec_id GROUP BY v.vec_id, v.label""",
)
def vector_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Length of every vector and its cosine with the centre of its label."""
    centres = label_centres(spark, sf).select(F.col("query_id").alias("label"), F.col("dense").alias("centre"))
    joined = read(spark, sf, "embeddings").join(centres, "label")
    return joined.select(
        F.col("vec_id").alias("id"),
        "label",
        F.round(norm(F.col("embedding")), 6).alias("norm"),
        F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"),
    )


@contract("dense_topk_cells", f"WITH {_CENTRES} SELECT query_id, id, score, rank::INT AS rank FROM best")
def dense_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same nearest vectors from points stored in cells, with cells pruned."""
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    centres = train_centres(vectors, 16, DIMENSION)
    path = shared_path(spark, "cells")
    write_cells(assign_cells(vectors, centres), path)
    placed = spark.read.parquet(path)
    return cell_top_k(placed, measure_cells(placed, centres), label_centres(spark, sf), 10)


@contract(
    "dense_approximate",
    """SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS queries, (SELECT count(*) FROM embeddings) AS indexed,
    true AS recall_reached, true AS fewer_scored""",
)
def dense_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate nearest ten of every fiftieth vector by a centre tree: recall against the exact search, and pairs scored."""
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    tree = train_tree(vectors, 8, 8, DIMENSION)
    path = shared_path(spark, "leaves")
    write_leaves(assign_leaves(vectors, tree), path)
    placed = spark.read.parquet(path)
    asked = vectors.filter(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id")
    # The test vectors are noise around a few centres, so near ones lie in many leaves.
    probe = len(tree.leaves) * 9 // 16
    found = leaf_top_k(placed, tree, asked, 10, probe)
    measured = recall(found, dense_top_k(vectors, asked, 10, DIMENSION))
    counts = asked.agg(F.count("*").alias("queries")).join(F.broadcast(placed.agg(F.count("*").alias("indexed"))))
    return counts.join(F.broadcast(measured)).join(F.broadcast(pairs_scored(placed, tree, asked, probe))).select(
        "queries", "indexed", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("scored") < F.col("all") * 0.65).alias("fewer_scored")
    )


@contract(
    "hash_embed",
    f"""WITH {_embedded("de", "documents", "doc_id", "text")}
    SELECT id, dim::INT AS dim, round(value, 6) AS value FROM de WHERE value <> 0""",
)
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in embedding of every document, non-zero cells in long form."""
    vectors = corpus(spark, sf).select("id", hashing_embedder(DIMENSION)(F.col("text")).alias("dense"))
    cells = explode_once(vectors, F.col("dense"), "value", "dim").filter(F.col("value") != 0)
    return cells.select("id", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


# Fusion and reranking --------------------------------------------------------


@contract(
    "rrf_fuse",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 10)}, {_EMBEDDINGS}, {_dense(10)}, {_fused(5)}
    SELECT query_id, id, round(score, 9) AS score, rank::INT AS rank FROM fused""",
)
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Both legs fused by reciprocal rank, five hits per question."""
    fused = retrieve(corpus(spark, sf), questions(spark, sf), SearchOptions(limit=5))
    return fused.withColumn("score", F.round("score", 9))


@contract(
    "collection_search",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 10)}, {_EMBEDDINGS}, {_dense(10)}, {_fused(5)}
    SELECT query_id, id::VARCHAR AS id, round(score, 9) AS score, rank::INT AS rank, source FROM fused
    JOIN documents ON doc_id = id""".replace("ORDER BY score DESC, id)", "ORDER BY score DESC, id::VARCHAR)"),
)
def collection_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search over a stored collection: vectors are read, not computed."""
    documents = read(spark, sf, "documents")
    items = documents.select(
        F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("source"), F.col("source")).alias("metadata")
    )
    stored = collection(spark, shared_path(spark, "collection"))
    stored.upsert(checked(build_points(items, hashing_embedder(DIMENSION)), DIMENSION))
    points = stored.read()
    corpus_points = points.withColumn("metadata", F.from_json("payload", "map<string,string>"))
    found = hybrid_search(corpus_points, questions(spark, sf), SearchOptions(limit=5))
    return found.select("query_id", "id", F.round("score", 9).alias("score"), "rank", found["metadata"]["source"].alias("source"))


@contract("bm25_postings", ORACLES["bm25_topk"])
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse leg from stored postings: columns of the asked terms, pruned by bounds."""
    path, texts = shared_path(spark, "postings"), corpus(spark, sf)
    write_postings(texts, path, segment_postings=1 << 16)
    return postings_top_k(spark.read.parquet(path), corpus_stats(texts), questions(spark, sf), 10)


@contract("bm25_blocks", ORACLES["bm25_topk"])
def bm25_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 where the questions come in several blocks, from texts that are tokenised once."""
    asked = questions(spark, sf)
    terms = asked.select(F.sum(F.size(tokens(F.col("query"))))).first()[0]
    return sparse_top_k(corpus(spark, sf), asked, 10, terms_per_block=-(-terms // 6))


@contract(
    "prepared_search",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 16)}, {_EMBEDDINGS}, {_dense(16)}, {_fused(8)}
    SELECT query_id, id::VARCHAR AS id, round(score, 9) AS score, rank::INT AS rank FROM fused""".replace(
        "ORDER BY score DESC, id)", "ORDER BY score DESC, id::VARCHAR)"
    ),
)
def prepared_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search of a stored collection with written statistics and vectors in cells."""
    space = Workspace(spark, shared_path(spark, "space"), DIMENSION)
    meta = F.create_map(F.lit("source"), F.col("source"))
    space.upsert(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", meta.alias("metadata")))
    space.prepare_search(cells=8)
    found = space.search(questions(spark, sf), SearchOptions(limit=8))
    return found.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@contract(
    "rrf_threshold",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 20)}, dense AS (SELECT * FROM sparse WHERE rank <= 10),
    {_fused(20, 0.02)} SELECT query_id, id, round(score, 9) AS score, rank::INT AS rank FROM fused""",
)
def rrf_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """A score threshold cuts on the fused score: short and long BM25 legs."""
    texts, asked = corpus(spark, sf), questions(spark, sf)
    long_leg = sparse_top_k(texts, asked, 20)
    short_leg = long_leg.filter(F.col("rank") <= 10)
    fused = fuse(union_legs(long=long_leg, short=short_leg), 20, score_threshold=0.02)
    return fused.withColumn("score", F.round("score", 9))


@contract(
    "hybrid_rerank",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 50)}, {_EMBEDDINGS}, {_dense(50)}, {_fused(25)}, {_reranked("fused", 5)}
    SELECT query_id, r.id::VARCHAR AS id, score, rank::INT AS rank, t.text, true AS reranked
    FROM reranked r JOIN documents t ON t.doc_id = r.id""",
)
def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search end to end: over-fetch, fuse, rerank, five hits."""
    return hybrid_search(corpus(spark, sf), questions(spark, sf), SearchOptions(limit=5, rerank=True))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    texts, asked = corpus(spark, sf), questions(spark, sf)
    hits = sparse_top_k(texts, asked, 10)
    return with_texts(hits, texts).join(asked, "query_id")


@contract(
    "overlap_rerank",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 10)}, {_reranked("sparse", 10)}
    SELECT query_id, id, score, rank::INT AS rank FROM reranked""",
)
def overlap_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 candidates reordered by word overlap; ties keep their order."""
    return rerank(_candidates(spark, sf)).select("query_id", "id", "score", "rank")


@contract(
    "ranker_reply",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 10)},
    scored AS (SELECT s.query_id, s.id, s.rank AS first_rank, round(l.quality + 1.0::DOUBLE / (s.rank + 1), 6) AS score
               FROM sparse s JOIN labels l ON l.doc_id = s.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank
               FROM scored QUALIFY rank <= 3)
    SELECT query_id, id, score, rank::INT AS rank FROM ranked""",
)
def ranker_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of an external ranker, here from labels: unnamed candidates go."""
    texts, asked = corpus(spark, sf), questions(spark, sf)
    candidates = sparse_top_k(texts, asked, 10)
    quality = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    replies = candidates.join(quality, "id").select(
        "query_id",
        (F.col("rank") - 1).alias("index"),
        F.round(F.col("quality") + F.lit(1.0) / (F.col("rank") + 1), 6).alias("relevance_score"),
    )
    return apply_ranker_reply(candidates, replies, 3).select("query_id", "id", "score", "rank")


# Context and routing ---------------------------------------------------------


@contract(
    "context_assemble",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 3)},
    cited AS (SELECT s.query_id, s.rank, t.text, '[Quelle: ' || t.source || '/' || t.doc_id || ']' AS citation
              FROM sparse s JOIN documents t ON t.doc_id = s.id)
    SELECT query_id, string_agg(text || chr(10) || citation, chr(10) || chr(10) ORDER BY rank) AS context,
           string_agg(citation, ' ' ORDER BY rank) AS citations, count(*)::INT AS hit_count
    FROM cited GROUP BY query_id""",
)
def context_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """One cited context per question from its three best documents."""
    documents = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    asked = questions(spark, sf)
    hits = with_texts(sparse_top_k(documents, asked, 3), documents)
    source = F.concat(F.col("source"), F.lit("/"), F.col("id").cast("string"))
    cited = hits.withColumn("citation", document_citation(source, F.lit(None)))
    return assemble(cited).withColumn("citations", F.array_join("citations", " "))


# Sentences put after the turns, with the routes they ask for, worked out by hand.
_ASKED_FOR = (
    ("", "direct"), (" Give me a summary of the contract", "direct"), (" Explain the counterpoint", "direct"), (" totally different", "direct"),
    (" What is the total?", "sql"), (" Zeig mir die Tabellen!", "sql"), (" which pages, which chapters", "vector"), (" A table, or an image", "vector"),
    (" Die Seiten mit der Summe", "sql"), (" imagery and sourcery", "direct"),
)


@contract(
    "route_questions",
    f"SELECT conv_id, turn, CASE (conv_id + turn) % {len(_ASKED_FOR)} "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(_ASKED_FOR))
    + " END AS route FROM conversations WHERE role = 'user'",
)
def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Route of every user turn, each with a sentence at its end."""
    turns = read(spark, sf, "conversations").filter(F.col("role") == "user")
    sentence = F.array(*[F.lit(text) for text, _ in _ASKED_FOR])[F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_ASKED_FOR))).cast("int")]
    return turns.select("conv_id", "turn", route(F.concat("text", sentence)).alias("route"))


@contract(
    "leg_topk",
    f"""WITH {_INDEX}, {_bm25(_ASKED, 10)},
    mine AS (SELECT query_id, t.source, s.id, s.score FROM sparse s JOIN documents t ON t.doc_id = s.id)
    SELECT query_id, source, id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, id, query_id)::INT AS rank
    FROM mine QUALIFY rank <= 3""",
)
def leg_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Best three hits of every source over all questions."""
    hits = sparse_top_k(corpus(spark, sf), questions(spark, sf), 10).drop("rank")
    sources = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    order = [F.desc("score"), F.asc("id"), F.asc("query_id")]
    return top_k(hits.join(sources, "id"), ["source"], order, 3, spread_by="id").select(
        "query_id", "source", "id", "score", "rank"
    )
