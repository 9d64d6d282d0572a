"""License scan by diagonal voting.

All rolling word k-grams of the documents are joined with the places of the
same k-grams in the templates. A match votes for its diagonal, the place in the
document less the place in the template: a passage that quotes a template piles
its votes on one diagonal, and an inserted or dropped word moves the rest to a
neighbouring one. Votes are summed per diagonal, neighbouring diagonals are
merged, and a merged span is accepted by the share of the template that it holds.

Templates are few and documents many: the join broadcasts the template side
after counting its k-grams, and shuffles both sides if there are too many.
Votes are counted per document, template and diagonal, so that no phrase is a hot
key, however common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once
from tabularium.llm.registry import ascii_lower, contract, read, row_key

# Words of a k-gram; no template has fewer.
GRAM = 3
# Diagonals this far apart may belong to one quotation.
NEAR = 4
# Share of a template's k-grams that a merged span has to hold.
COVERAGE = 0.6

# Template k-grams, of some 50 bytes each, that a broadcast may have.
BROADCAST_GRAMS = 200_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels; they count only where they stand in full.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Opening words of common licence texts and their labels; these may be quoted in part.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
)


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def grams(of: Column, size: int = GRAM) -> Column:
    """``array<struct<place, gram>>`` of all rolling k-grams; empty for fewer words."""
    places = F.when(F.size(of) >= size, F.sequence(F.lit(0), F.size(of) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(of, i + j) for j in range(size)]).alias("gram")))


def template_table(spark: SparkSession, base=BASE, texts=TEXTS) -> DataFrame:
    """``template, label, is_base, n_words, spelled``."""
    rows = [(t, label, True) for t, label in base] + [(t, label, False) for t, label in texts]
    rows = [(i, label, is_base, len(t.split()), t) for i, (t, label, is_base) in enumerate(rows)]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, n_words int, spelled string")


def scan(documents: DataFrame, templates: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_words, spans``: every document with its accepted spans.

    A span is ``label, is_base, first, last, coverage, template``, its words from
    0. A base phrase is accepted at each place where all of its words stand
    consecutively; other templates where merged diagonals hold at least
    ``COVERAGE`` of their k-grams. Null and empty texts have no words and no
    spans. Repeated rows each get the same result; an empty table gives none.
    """
    documents = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    documents = documents.select("id", row_key(F.col("id"), F.col("text")).alias("key"), words(F.col("text")).alias("words"))
    rolled = explode_once(documents.select("key", grams(F.col("words")).alias("grams")), F.col("grams"), "at")
    rolled = rolled.select("key", F.col("at.place").alias("place"), F.col("at.gram").alias("gram"))
    spelled = templates.select("template", "n_words", "is_base", "label", F.explode(grams(F.split("spelled", " "))).alias("at"))
    spelled = spelled.select("template", "n_words", "is_base", "label", F.col("at.place").alias("inside"), F.col("at.gram").alias("gram"))
    if spelled.count() <= BROADCAST_GRAMS:
        spelled = F.broadcast(spelled)
    # A repeated row repeats its votes: a diagonal holds a template's places once.
    votes = (
        rolled.join(spelled, "gram")
        .withColumn("diagonal", F.col("place") - F.col("inside"))
        .groupBy("key", "template", "n_words", "is_base", "label", "diagonal")
        .agg(F.collect_set("inside").alias("held"))
    )
    by_diagonal = Window.partitionBy("key", "template").orderBy("diagonal")
    # Base phrases are never merged: each diagonal is a place of its own.
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR) | F.col("is_base"), F.lit(True))
    merged = (
        votes.withColumn("run", F.sum(apart.cast("int")).over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "template", "n_words", "is_base", "label", "run")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n_held"),
            F.min(F.col("diagonal") + F.array_min("held")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("held") + GRAM - 1).alias("last"),
        )
    )
    coverage = F.col("n_held") / (F.col("n_words") - GRAM + 1)
    spans = merged.withColumn("coverage", coverage).filter(
        F.when(F.col("is_base"), F.col("coverage") == 1.0).otherwise(F.col("coverage") >= COVERAGE)
    )
    found = spans.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("label", "is_base", "first", "last", "coverage", "template"))).alias("spans")
    )
    none = F.array().cast("array<struct<label:string,is_base:boolean,first:int,last:int,coverage:double,template:int>>")
    sized = documents.select("id", "key", F.size("words").cast("long").alias("n_words"))
    return sized.join(found, "key", "left").select("id", "n_words", F.coalesce("spans", none).alias("spans")).withColumnRenamed("id", id_column)


def _sql_words(of: str) -> str:
    lowered = f"translate({of}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_SQL_TEMPLATES = ", ".join(
    f"({i}, '{label}', {'true' if i < len(BASE) else 'false'}, string_split('{text}', ' '))" for i, (text, label) in enumerate(BASE + TEXTS)
)
_SQL_GRAMS = "list_transform(range(0, len({0}) - 2), lambda i: {{'place': i, 'gram': {0}[i + 1] || ' ' || {0}[i + 2] || ' ' || {0}[i + 3]}})"
_SQL = f"""
WITH docs AS (SELECT doc_id, {_sql_words("coalesce(text, '')")} AS words FROM documents),
rolled AS (SELECT doc_id, unnest({_SQL_GRAMS.format("words")}) AS at FROM docs WHERE len(words) >= 3),
templates(template, label, is_base, words) AS (VALUES {_SQL_TEMPLATES}),
spelled AS (SELECT template, label, is_base, len(words) AS n, unnest({_SQL_GRAMS.format("words")}) AS at FROM templates),
votes AS (
  SELECT doc_id, template, label, is_base, n, r.at.place - s.at.place AS diagonal, list(DISTINCT s.at.place) AS held
  FROM rolled r JOIN spelled s ON r.at.gram = s.at.gram GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN is_base OR diagonal - lag(diagonal) OVER w <= {NEAR} IS NOT TRUE THEN 1 ELSE 0 END AS apart
  FROM votes WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM marked),
merged AS (
  SELECT doc_id, template, label, is_base, run, len(list_distinct(flatten(list(held)))) / (n - 2) AS coverage,
    min(diagonal + list_min(held)) AS first, max(diagonal + list_max(held) + 2) AS last
  FROM runs GROUP BY doc_id, template, label, is_base, n, run),
spans AS (SELECT * FROM merged WHERE CASE WHEN is_base THEN coverage = 1 ELSE coverage >= {COVERAGE} END),
found AS (
  SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word, max(first) FILTER (is_base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM spans GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM docs LEFT JOIN found USING (doc_id)
"""


@contract("op9_license_scan", _SQL)
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Score: the largest share of a template that an accepted span holds; 1 for a base phrase, 0 without spans."""
    scanned = scan(read(spark, folder, "documents"), template_table(spark))
    base = F.filter("spans", lambda span: span["is_base"])
    starts = F.transform(base, lambda span: span["first"].cast("long"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda span: span["label"]))), ",")

    best = F.array_max(F.transform("spans", lambda span: span["coverage"]))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
