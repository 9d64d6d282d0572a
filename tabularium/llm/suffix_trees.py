"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes of the corpus's word sequences are split by their prefixes into groups
that fit a task's memory. The first prefix of a suffix is the gram at its anchor
(see ``repeats``); a prefix that is too frequent is lengthened, in the end to the
whole window. Each group gets a suffix tree, kept as its sorted leaves and the
depths between them: an internal node is an interval of leaves whose depths
between do not fall below its own. The nodes at least a window deep are the
maximal repeats, and their leaves start repeated windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabularium.llm.registry import contract, read, row_key
from tabularium.llm.repeats import FILTER_BITS, HOT, Tokens, merged, repeated_spans
from tabularium.llm.suffix_runs import suffix_order
from tabularium.llm.words import SPACES, word_hashes

# Words of a window that counts as repeated.
LENGTH = 35
# Words of the shortest prefix.
GRAM = 8

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = word_hashes(b" ".join(texts), SPACES)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


WORDS = Tokens(_cut_words, lambda values: values)


def suffix_tree(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and depths of the suffix tree of some word sequences.

    ``leaves`` are places in the joined sequences, each followed by an end of its
    own, in the order of the tree; ``depths[i]`` is the depth in words of the node
    at which leaf ``i`` parts from leaf ``i - 1``, 0 for the first.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    inside = np.ones(n, bool)
    inside[ends] = False
    symbols = np.empty(n, np.int64)
    known, symbols[inside] = np.unique(np.concatenate(texts), return_inverse=True)
    symbols[inside] += len(texts)
    symbols[ends] = np.arange(len(texts))
    leaves = suffix_order(symbols, len(texts) + len(known))
    depths = np.zeros(n, np.int64)
    padded = np.append(symbols, -1)
    same = np.arange(1, n)
    depth = 0
    while len(same):
        # Ends are all different, so that no two suffixes are equal throughout.
        same = same[padded[leaves[same] + depth] == padded[leaves[same - 1] + depth]]
        depth += 1
        depths[same] = depth
    return leaves, depths


def internal_nodes(depths: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(depth, first, last)``: the internal nodes at least ``least`` deep, as intervals of leaves.

    Each is a maximal repeat to the right: its leaves agree on ``depth`` words
    and no further.
    """
    nodes, open_ = [], []
    for i, depth in enumerate([*depths.tolist(), 0]):
        first = i - 1
        while open_ and open_[-1][0] > depth:
            above, first = open_.pop()
            nodes.append((above, first, i - 1))
        if depth >= least and (not open_ or open_[-1][0] < depth):
            open_.append((depth, first))
    return nodes


def deep_leaves(texts: list[bytes], several: list[bool], length: int) -> list[np.ndarray]:
    """For each sequence (of 64-bit word hashes) the places of leaves below nodes at least ``length`` words deep.

    A sequence that stands in several places is one leaf of several occurrences:
    all its suffixes of that length are nodes.
    """
    sequences = [np.frombuffer(text, np.uint64) for text in texts]
    leaves, depths = suffix_tree(sequences)
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    deep = np.zeros(int(starts[-1]), bool)
    at = np.zeros(len(leaves) + 1, np.int64)
    for _, first, last in internal_nodes(depths, length):
        at[first] += 1
        at[last + 1] -= 1
    deep[leaves[np.cumsum(at[:-1]) > 0]] = True
    left = np.repeat(starts[1:] - 1, sizes + 1) - np.arange(len(deep))
    deep |= np.repeat(several, sizes + 1) & (left >= length)
    return [np.flatnonzero(deep[starts[i] : starts[i + 1]]) for i in range(len(texts))]


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, texts = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            buffer = text.as_buffer()
            words = _WORD.findall(buffer.to_pybytes() if buffer is not None else b"")
            runs = merged(spans)
            kept, at = [], 0
            for start, stop in runs:
                kept += words[at:start]
                at = stop
            kept += words[at:]
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept))
        others = [name for name in batch.schema.names if name != "spans"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in others), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            names=[*others, "n_words", "n_removed", "kept"],
        )


def _cut(rows: DataFrame, length: int, gram: int, hot: int, filter_bits: int) -> DataFrame:
    """``n_words, n_removed, kept`` beside the columns of rows with ``key, text``, without ``key``."""
    spans = repeated_spans(rows, WORDS, deep_leaves, gram, length, hot, filter_bits)
    joined = rows.join(spans, "key", "left").drop("key")
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    return joined.mapInArrow(_remover, StructType([*(f for f in joined.schema.fields if f.name != "spans"), *added]))


def remove_repeated_words(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
    gram: int = GRAM, hot: int = HOT, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``id, text, n_words, n_removed, kept``: each document without its repeated words.

    Words are runs of characters other than white space. A word goes if a window
    of ``length`` consecutive words over it also starts at another place, of this
    document or any other; windows are judged on the input. ``kept`` has the other
    words, unchanged, one space between. Null and empty texts have no words. Equal
    rows are documents of their own and repeat each other. Only the id and the text
    are read.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key(F.col("id"), F.col("text")))
    return _cut(rows, length, gram, hot, filter_bits).withColumnsRenamed({"id": id_column, "text": text_column})


def with_unique_words(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """The documents with repeated words taken out of their texts.

    Texts that lose no word stay as they are; of the others the words left are
    joined by a space, and ``size_column``, if there is one, is set anew. All
    documents and columns stay; a text may become empty.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.struct("*").alias("row"), text.alias("text"), row_key(F.col(id_column), text).alias("key"))
    cut = _cut(rows, LENGTH, GRAM, HOT, FILTER_BITS)
    changed = F.col("n_removed") > 0
    new = {text_column: F.when(changed, F.col("kept")).otherwise(F.col("row").getField(text_column))}
    if size_column in documents.columns:
        kind = documents.schema[size_column].dataType
        new[size_column] = F.when(changed, F.length("kept").cast(kind)).otherwise(F.col("row").getField(size_column))
    return cut.select(*[new.get(name, F.col("row").getField(name)).alias(name) for name in documents.columns])


@contract("op7_suffix_trees")
def op7_suffix_trees(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_words(read(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
