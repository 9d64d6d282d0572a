"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (line) of a text is hashed to a wide vector, and a fingerprint is
the sum of its paragraphs' vectors, every component modulo 2^32. So it does not
depend on the order of the paragraphs, and a paragraph is inserted or deleted by
adding or subtracting its vector.

A vector has three parts:

* ``DENSE`` components hashed from the paragraph as a whole. They decide
  equality: two different multisets agree with a chance of 2^-256, taking the
  hash as random.
* ``LANES`` counts of the set bits in the hashes of the paragraph's runs of
  ``RUN`` words. Twice a count less the number of runs is a sum of random signs,
  and the mean square of the differences of two such sums estimates how many
  runs the two texts do not share.
* the number of runs.

Everything is a built-in function. Runs are exploded and summed per document
where they are made; what is shuffled is one row of sums per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.arrays import explode_once
from tabularium.llm.registry import contract, read, row_key
from tabularium.session import shared_path

DENSE = 8
LANES = 64
# Words of a run; a paragraph with fewer words, or none, counts as one run.
RUN = 3

_MASK = 0xFFFFFFFF
# Lanes i and i + 32 are summed in the two halves of one long.
_HALVES = 0x0000000100000001


def _summed() -> list[Column]:
    dense = []
    for i in range(DENSE // 2):
        whole = F.col(f"dense{i}")
        dense += [F.sum(whole.bitwiseAND(_MASK)).alias(f"d{2 * i}"), F.sum(F.shiftrightunsigned(whole, 32)).alias(f"d{2 * i + 1}")]
    lanes = [F.sum(F.shiftrightunsigned("run", i).bitwiseAND(_HALVES)).alias(f"l{i}") for i in range(LANES // 2)]
    return [*dense, *lanes, F.count("*").alias("n_runs")]


def fingerprints(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``*keys, fingerprint``: the sum of the paragraphs' vectors per key.

    ``fingerprint`` is ``struct<dense, lanes, n_runs>`` of longs. Rows that share
    a key are added up, as insertion does. A null text is an empty one; an empty
    text is one empty paragraph, so that it has a vector as well.
    """
    lines = texts.select(*keys, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines"))
    lines = explode_once(lines, F.col("lines"), "line").select(*keys, "line")
    lines = lines.select(
        *keys, *[F.conv(F.substring(F.sha2("line", 256), 16 * i + 1, 16), 16, -10).cast("long").alias(f"dense{i}") for i in range(DENSE // 2)],
        F.filter(F.split("line", r"\s+", -1), lambda word: word != "").alias("words"),
    )
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - RUN, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(RUN)]),
    )
    kept = [f"dense{i}" for i in range(DENSE // 2)]
    each = explode_once(lines.select(*keys, *kept, runs.alias("runs")), F.col("runs"), "run", "place")
    # The first run of a paragraph brings the paragraph's own part along.
    first = [F.when(F.col("place") == 0, F.col(c)).otherwise(F.lit(0)).alias(c) for c in kept]
    sums = each.select(*keys, *first, "run").groupBy(*keys).agg(*_summed())
    dense = F.array(*[F.col(f"d{i}").bitwiseAND(_MASK) for i in range(DENSE)])
    low = [F.col(f"l{i}").bitwiseAND(_MASK) for i in range(LANES // 2)]
    high = [F.shiftrightunsigned(f"l{i}", 32) for i in range(LANES // 2)]
    return sums.select(*keys, F.struct(dense.alias("dense"), F.array(*low, *high).alias("lanes"), "n_runs").alias("fingerprint"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    def part(name: str) -> Column:
        return F.zip_with(a[name], b[name], lambda x, y: (x + sign * y).bitwiseAND(_MASK)).alias(name)

    return F.struct(part("dense"), part("lanes"), (a["n_runs"] + sign * b["n_runs"]).alias("n_runs"))


def inserted(fingerprint: Column, part: Column) -> Column:
    """The fingerprint after the paragraphs of ``part`` have been inserted, wherever."""
    return _combined(fingerprint, part, 1)


def deleted(fingerprint: Column, part: Column) -> Column:
    """The fingerprint after the paragraphs of ``part`` have been deleted."""
    return _combined(fingerprint, part, -1)


def spelled(fingerprint: Column) -> Column:
    """The part that decides equality, and the number of runs, in hex digits."""
    return F.concat(
        F.array_join(F.transform(fingerprint["dense"], lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lpad(F.hex(fingerprint["n_runs"]), 8, "0")
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the runs of either text that both have, 0 to 1; equal fingerprints: 1.

    The standard error of the number of runs not shared is about ``sqrt(2 / LANES)`` of it.
    """
    gap = (a["n_runs"] - b["n_runs"]).cast("double")
    squares = F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pow(2.0 * (x - y) - gap, F.lit(2.0)))
    apart = F.aggregate(squares, F.lit(0.0), lambda total, x: total + x) / LANES
    both = (a["n_runs"] + b["n_runs"]).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - apart) / (both + apart)))


def successors(keyed: DataFrame, order: str, key: str) -> DataFrame:
    """``key, next_key``: the row after each in the order of ``order`` and ``key``; after the last comes the first.

    ``keyed`` has no repeated keys. Rows are dealt by range, each range is ordered
    by itself, and only the ranges' first rows meet in one place: as many rows as
    there are partitions, whatever the input.
    """
    spark = keyed.sparkSession
    dealt = keyed.select(order, key).repartitionByRange(F.col(order).asc_nulls_first(), F.col(key))
    path = shared_path(spark, "ranges")
    dealt.withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    inside = Window.partitionBy("part").orderBy(F.col(order).asc_nulls_first(), key)
    led = dealt.select(key, "part", F.lead(key).over(inside).alias("next_key"))
    firsts = dealt.groupBy("part").agg(F.min_by(key, F.struct(order, key)).alias("first_key"))
    over_parts = Window.orderBy("part")
    ring = firsts.select(
        "part",
        F.coalesce(F.lead("first_key").over(over_parts), F.first("first_key").over(over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"),
    )
    # One row per partition: Spark's own size check makes this a broadcast.
    return led.join(ring, "part").select(key, F.coalesce("next_key", "after").alias("next_key"))


def edit_report(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text, and of the text with its last quarter taken from the next document's start.

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, fingerprints as ``spelled``, nearness as ``likeness``. Null texts are empty; the next document is the one with
    the next id, ties by a hash of the text, and after the last comes the first; a
    null id comes first. Rows equal in id and text are one document and give equal
    rows; a lone document is its own next one; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("key", row_key(F.col("id"), F.col("text")))
    counted = rows.groupBy("key", "id").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    spark = documents.sparkSession
    path = shared_path(spark, "chain")
    chain = successors(counted, "id", "key").join(counted.select("key", "copies", "n_chars"), "key")
    chain.write.parquet(path)
    chain = spark.read.parquet(path)
    # One struct, so that both joins below read one and the same shuffle of the texts.
    whole = rows.groupBy("key").agg(F.first(F.struct("id", "text")).alias("doc"))
    # How much of a document's start goes to the document before it.
    wanted = chain.select(F.col("next_key").alias("key"), F.col("key").alias("to"), F.floor(F.col("n_chars") / 4).cast("int").alias("want"))
    heads = whole.join(wanted, "key").select(F.col("to").alias("key"), F.substring(F.col("doc.text"), F.lit(1), F.col("want")).alias("head"))
    own = F.col("doc.text")
    kept = F.substring(own, F.lit(1), F.length(own) - F.floor(F.length(own) / 4).cast("int"))
    edited = whole.join(heads, "key").select("key", "doc", F.concat(kept, "head").alias("edited"))
    both = edited.select(
        "key", F.col("doc.id").alias("id"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array(F.struct(F.lit(0).alias("which"), own.alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))).alias("versions"),
    )
    both = explode_once(both, F.col("versions"), "version").select("key", "id", "edited_sha256", "version.which", "version.text")
    prints = fingerprints(both, "key", "id", "edited_sha256", "which")
    paired = prints.groupBy("key", "id", "edited_sha256").agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("other"),
    )
    # From here on a row keeps of the two vectors what is still to be compared.
    paired = paired.select(
        "key", "id", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        F.struct(F.col("own.lanes").cast("array<int>").alias("lanes"), "own.n_runs").alias("own"),
    )
    path = shared_path(spark, "prints")
    paired.write.parquet(path)
    paired = spark.read.parquet(path)
    nexts = paired.select(F.col("key").alias("next_key"), F.col("own").alias("next"))
    nexts = chain.select("key", "next_key", "copies", "n_chars").join(nexts, "next_key").drop("next_key")
    told = paired.join(nexts, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return told.select(
        F.col("id").alias(id_column), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


@contract("op5_multiset_hash")
def op5_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return edit_report(read(spark, folder, "documents"))
