"""Suffix-array dedup: repeated byte strings by a run-length index.

The corpus is dealt in groups of stretches that can share a repeated string (see
``repeats``). Each group of texts is indexed as an r-index is: the suffixes are
sorted, the Burrows-Wheeler transform is compressed to its runs, and the suffix
array is sampled at run ends only. The longest match of a suffix with its
neighbours in the suffix array is compared letter by letter at those samples and
nowhere else: between two samples, one step on in the text makes a match one
shorter. So matching statistics stream along the text from sample to sample, and
repetitive texts, which have few runs, need few comparisons.

A stretch that stands in several places is indexed once; its copies are matches
as long as itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.registry import contract, read, row_key
from tabularium.llm.repeats import FILTER_BITS, HOT, Tokens, merged, repeated_spans

# Bytes of a gram that anchors windows.
GRAM = 24
# Bytes of a string that counts as repeated.
LENGTH = 200


def suffix_order(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array, by doubling the sorted prefix; only unsettled suffixes are sorted again.

    Symbols are below ``alphabet``, and no two suffixes are equal.
    """
    n = len(symbols)
    width = int(alphabet + 1).bit_length()
    packed = 62 // width
    padded = np.concatenate((symbols.astype(np.int64) + 1, np.zeros(packed, np.int64)))
    keys = np.zeros(n, np.int64)
    for i in range(packed):
        keys = (keys << width) | padded[i : i + n]
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1

    def settle(places: np.ndarray, fresh: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Ranks the sorted places, equal where not fresh, as the first of their group; returns those not alone."""
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(places)))
        ranks[places] = np.repeat(base[heads], sizes)
        return places[np.repeat(sizes > 1, sizes)]

    ordered = keys[order]
    active = settle(order, np.append(True, ordered[1:] != ordered[:-1]), np.arange(n))
    span = packed
    while len(active):
        own, later = ranks[active], ranks[np.minimum(active + span, n)]
        again = np.argsort(own * (n + 1) + later + 1, kind="stable")
        active, own, later = active[again], own[again], later[again]
        group = np.append(True, own[1:] != own[:-1])
        heads = np.flatnonzero(group)
        inside = np.arange(len(active)) - np.repeat(heads, np.diff(np.append(heads, len(active))))
        active = settle(active, group | np.append(True, later[1:] != later[:-1]), own + inside)
        span *= 2
    order = np.empty(n, np.int64)
    order[ranks[:n]] = np.arange(n)
    return order


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of ``data[a:]`` and ``data[b:]``, at most ``most``; ``data`` ends in 8 spare bytes."""
    eight = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | data[i : len(data) - 7 + i].astype(np.uint64)
    found = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    done = 0
    while len(open_):
        differ = eight[a[open_] + done] ^ eight[b[open_] + done]
        over = differ != 0
        equal = sum((differ[over] < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))
        found[open_[over]] = done + equal
        rest = open_[~over]
        done += 8
        found[rest] = done
        open_ = rest[most[rest] > done]
    return np.minimum(found, most)


def run_length_matches(texts: list[bytes], several: list[bool], length: int) -> list[np.ndarray]:
    """For each text the offsets whose longest match elsewhere, in any text, has at least ``length`` bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    n = int(starts[-1])
    data = np.zeros(n + 8, np.uint8)
    joined = b"\0".join(texts) + b"\0"
    data[:n] = np.frombuffer(joined, np.uint8)
    # Each text ends in a symbol of its own, below all bytes, so that no match passes an end.
    symbols = data[:n].astype(np.int64) + len(texts)
    symbols[starts[1:] - 1] = np.arange(len(texts))
    order = suffix_order(symbols, len(texts) + 256)
    # Runs of the transform: the symbol before each suffix, in suffix order.
    before = symbols[order - 1]
    heads = np.flatnonzero(before[1:] != before[:-1]) + 1
    left = np.repeat(starts[1:] - 1, sizes + 1) - np.arange(n)
    upper, lower = order[heads - 1], order[heads]
    match = common_prefixes(data, upper, lower, np.minimum(left[upper], left[lower]))
    longest = np.zeros(n, np.int64)
    places = np.arange(n)
    for sampled in (lower, upper):
        # Streams along the text: a match shrinks by one per step until the next sample.
        ends = np.full(n, -1, np.int64)
        ends[sampled] = sampled + match
        # The first or last row of the whole order has no neighbour on one side.
        rim = order[0] if sampled is lower else order[-1]
        ends[rim] = rim
        known = np.maximum.accumulate(np.where(ends >= 0, places, 0))
        longest = np.maximum(longest, ends[known] - places)
    longest = np.where(np.repeat(several, sizes + 1), np.maximum(longest, left), longest)
    repeated = longest >= length
    return [np.flatnonzero(repeated[starts[i] : starts[i + 1]]) for i in range(len(texts))]


def _cut_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


BYTES = Tokens(_cut_bytes, lambda values: values.astype(np.uint64) + np.uint64(1))

_CUT = "id {id}, n_bytes long, n_removed long, n_spans long, kept binary"


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            buffer = text.as_buffer()
            raw = buffer.to_pybytes() if buffer is not None else b""
            runs = merged(spans)
            kept, at = [], 0
            for start, stop in runs:
                kept.append(raw[at:start])
                at = stop
            kept.append(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), b"".join(kept)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(columns[i], pa.int64()) for i in range(3)], pa.array(columns[3], pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeated_bytes(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
    gram: int = GRAM, hot: int = HOT, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept``: each document without its repeated bytes.

    A byte goes if a ``length``-byte string over it starts at another place too,
    of this document or any other, overlaps included; strings are judged on the
    input. ``kept`` is what is left, joined; it may end inside a character. Null
    and empty texts have nothing to remove. Equal rows are documents of their own
    and repeat each other. Only the id and the text are read.
    """
    documents = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    documents = documents.withColumn("key", row_key(F.col("id"), F.col("text")))
    spans = repeated_spans(documents, BYTES, run_length_matches, gram, length, hot, filter_bits)
    kind = dict(documents.dtypes)["id"]
    joined = documents.join(spans, "key", "left").select("id", "text", "spans")
    return joined.mapInArrow(_remover, _CUT.format(id=kind)).withColumnRenamed("id", id_column)


@contract("op1_suffix_runs")
def op1_suffix_runs(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_bytes(read(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
