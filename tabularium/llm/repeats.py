"""Repeated windows of a corpus: the part that the two substring operators share.

A window is ``length`` consecutive tokens (bytes or words) of one document. Every
window has an anchor: of the short grams inside it, the leftmost with the
smallest hash. Equal windows have equal anchors, so windows can only be repeated
within the group of their anchor's gram, and consecutive windows with one anchor
travel together as one *stretch* of text, a little longer than a window.

1. Grams of anchors are counted over all documents. A gram seen once holds no
   repeated window. The others set a bit in a filter of a fixed number of bits;
   a wrongly set bit only makes work.
2. Stretches whose gram passes the filter are dealt by gram. Equal stretches of a
   map task travel once, with the list of their places.
3. A task indexes a few whole groups at a time (the caller's index decides which
   windows are repeated) and emits the repeated places.

A gram seen more than ``hot`` times would make too large a group. Its windows are
counted instead, by 128 bits of their digest: blocks of texts ask shards of the digest
space about their distinct windows, with one bit for those that they hold twice
themselves; a shard answers with one bit for each, and the block puts the places of
repeated windows together to spans before anything else leaves it. So a window with
millions of places travels once per block. No row is dropped and no group capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.words import BLOCK, mixed, rolling, texts_of
from tabularium.session import shared_path

# Bits of the filter of repeated grams; its size does not depend on the input.
FILTER_BITS = 1 << 27
# Occurrences beyond which a gram is too short a key.
HOT = 4096
_PLACE_BITS = 21
# Bytes of stretches indexed at once, besides the last group.
_INDEX_BYTES = 1 << 20
# Places of counted windows in a block, and windows that a shard counts at once, about.
_BLOCK_PLACES = 1 << 19
_SHARD_WINDOWS = 1 << 20

def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(values: np.ndarray, bounds: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window starts and the gram hash of each stretch.

    ``values`` holds the tokens of several texts, cut at ``bounds`` (from 0 to
    its length); no window crosses a bound.
    """
    none = np.zeros(0, np.int64)
    n = len(values)
    if n < length:
        return none, none, none
    grams = mixed(rolling(values, gram))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    anchors = (least & low).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(anchors)]
    # Stretches of different texts, or of a window that fits none, never join.
    anchors[ends < np.arange(len(anchors)) + length] = -1
    cut = np.flatnonzero(np.diff(anchors)) + 1
    firsts = np.concatenate(([0], cut))
    lasts = np.concatenate((cut - 1, [len(anchors) - 1]))
    fits = anchors[firsts] >= 0
    firsts, lasts = firsts[fits], lasts[fits]
    return firsts, lasts, grams[anchors[firsts]].view(np.int64)


@dataclass(frozen=True)
class Tokens:
    """How texts become tokens: ``cut`` gives the tokens and bounds of some texts, ``hashed`` what is hashed of them."""

    cut: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    hashed: Callable[[np.ndarray], np.ndarray]


def _pieces(tokens: Tokens, texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, bounds, and for each text the number and the place of its first token.

    A text of more than a block is handled in blocks that overlap by a window
    less one token, so that each window is in one of them.
    """
    whole, bounds = tokens.cut(texts)
    if len(whole) <= 2 * BLOCK:
        yield whole, bounds, np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return
    for i in range(len(texts)):
        one = whole[bounds[i] : bounds[i + 1]]
        for at in range(0, max(len(one) - length + 1, 1), BLOCK):
            part = one[at : at + BLOCK + length - 1]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([at])


def _gram_counter(tokens: Tokens, gram: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches):
            for values, bounds, _, _ in _pieces(tokens, texts, length):
                _, _, grams = stretches(tokens.hashed(values), bounds, gram, length)
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["gram", "n"])

    return run


def _is_set(bits, slots: np.ndarray) -> np.ndarray:
    marked = np.frombuffer(bits.value, np.uint64)
    return (marked[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def _stretch_finder(tokens: Tokens, gram: int, length: int, bits, hot_bits, filter_bits: int):
    """Stretches of repeated grams that are not hot, with their places."""
    schema = pa.schema([("gram", pa.int64()), ("content", pa.binary()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
    flush = 1 << 22

    def record(found: dict) -> pa.RecordBatch:
        sizes = np.fromiter((len(v) // 2 for v in found.values()), np.int64, len(found))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        flat = np.fromiter((x for v in found.values() for x in v), np.int64, 2 * int(sizes.sum()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(flat[0::2])), pa.ListArray.from_arrays(offsets, pa.array(flat[1::2])),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], list[int]] = {}
        size = 0
        for keys, texts in texts_of(batches):
            for values, bounds, owners, bases in _pieces(tokens, texts, length):
                firsts, lasts, grams = stretches(tokens.hashed(values), bounds, gram, length)
                slots = grams.view(np.uint64) & np.uint64(filter_bits - 1)
                kept = _is_set(bits, slots) & ~_is_set(hot_bits, slots)
                firsts, lasts, grams = firsts[kept], lasts[kept], grams[kept]
                text = np.searchsorted(bounds, firsts, "right") - 1
                places = firsts - bounds[text] + bases[text]
                wide = values.itemsize
                raw = values.tobytes()
                for a, b, g, t, place in zip(firsts.tolist(), lasts.tolist(), grams.tolist(), text.tolist(), places.tolist(), strict=True):
                    content = raw[a * wide : (b + length) * wide]
                    at = found.setdefault((g, content), [])
                    size += 16 + len(content) * (not at)
                    at += (keys[owners[t]], place)
                if size > flush:
                    yield record(found)
                    found, size = {}, 0
        if found:
            yield record(found)

    return run


_BLOCK = "block long, keys array<long>, texts binary, places binary, which binary, windows binary, n long"


def _window_blocks(tokens: Tokens, gram: int, length: int, hot_bits, filter_bits: int):
    """Windows of hot grams: their digests, each once, and for each place its text, its first token and the number of its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_blocks = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        names, numbers, places, which, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            row = [
                (part << 32) + n_blocks, names, np.concatenate(numbers).astype("<i4").tobytes(), np.concatenate(places).astype("<i8").tobytes(),
                np.array(which, "<i4").tobytes(), b"".join(known), len(known),
            ]
            types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["block", "keys", "texts", "places", "which", "windows", "n"])

        for keys, texts in texts_of(batches):
            for values, bounds, owners, bases in _pieces(tokens, texts, length):
                firsts, lasts, grams = stretches(tokens.hashed(values), bounds, gram, length)
                kept = _is_set(hot_bits, grams.view(np.uint64) & np.uint64(filter_bits - 1))
                firsts, sizes = firsts[kept], (lasts - firsts + 1)[kept]
                if not len(firsts):
                    continue
                starts = np.repeat(firsts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                text = np.searchsorted(bounds, starts, "right") - 1
                wide, raw = values.itemsize, values.tobytes()
                for a in starts.tolist():
                    digest = hashlib.blake2b(raw[a * wide : (a + length) * wide], digest_size=16).digest()
                    which.append(known.setdefault(digest, len(known)))
                used, number = np.unique(text, return_inverse=True)
                numbers.append(len(names) + number)
                names += [keys[owners[t]] for t in used.tolist()]
                places.append(starts - bounds[text] + bases[text])
                size += len(starts)
                if size >= _BLOCK_PLACES:
                    yield block()
                    n_blocks += 1
                    known, names, numbers, places, which, size = {}, [], [], [], [], 0
        if names:
            yield block()

    return run


def _windows_in_order(windows: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digests as pairs of numbers, and their order."""
    pairs = np.frombuffer(windows, "<u8").reshape(-1, 2)
    return pairs, np.lexsort((pairs[:, 1], pairs[:, 0]))


def _windows_asked(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pairs, order = _windows_in_order(row["windows"])
                twice = (np.bincount(np.frombuffer(row["which"], "<i4"), minlength=len(pairs)) > 1)[order]
                pairs = pairs[order]
                shards = (pairs[:, 0] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(pairs), np.int64)
                edges = np.concatenate((np.flatnonzero(np.diff(shards, prepend=-1)), [len(pairs)]))
                out = [(int(shards[a]), row["block"], pairs[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["shard", "block", "windows", "twice"])

    return run


def _windows_answered(group: pa.Table) -> pa.Table:
    """For each asking block a bit per window: whether it stands in several places."""
    rows = group.to_pylist()
    sizes = [len(r["windows"]) // 16 for r in rows]
    pairs = np.frombuffer(b"".join(r["windows"] for r in rows), "<u8").reshape(-1, 2)
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    fresh = np.concatenate(([True], (pairs[order[1:]] != pairs[order[:-1]]).any(axis=1)))
    # Each block that holds a window counts once, and once more if it holds it twice.
    counts = np.add.reduceat(1 + twice[order].astype(np.int64), np.flatnonzero(fresh))
    several = np.empty(len(pairs), np.uint8)
    several[order] = (counts > 1)[np.cumsum(fresh) - 1]
    ends = np.cumsum(sizes)
    bits = [np.packbits(several[end - n : end]).tobytes() for n, end in zip(sizes, ends, strict=True)]
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _window_spans(length: int):
    """The spans that a block's repeated windows cover, neighbouring and overlapping ones as one."""

    def spans(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        told = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        _, order = _windows_in_order(row["windows"])
        several = np.zeros(len(order), bool)
        several[order] = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in told]) == 1
        chosen = several[np.frombuffer(row["which"], "<i4")]
        text, place = np.frombuffer(row["texts"], "<i4")[chosen], np.frombuffer(row["places"], "<i8")[chosen]
        sorted_places = np.lexsort((place, text))
        text, place = text[sorted_places], place[sorted_places]
        first = np.concatenate(([True], (text[1:] != text[:-1]) | (place[1:] > place[:-1] + length))) if len(text) else np.zeros(0, bool)
        last = np.append(first[1:], True) if len(text) else first
        keys = np.array(row["keys"], np.int64)
        return pa.table({"key": pa.array(keys[text[first]]), "start": pa.array(place[first]), "stop": pa.array(place[last] + length)})

    return spans


def _counted_spans(texts: DataFrame, tokens: Tokens, gram: int, length: int, hot_bits, filter_bits: int) -> DataFrame:
    """``key, start, stop`` of what repeated windows of hot grams cover."""
    spark = texts.sparkSession
    path = shared_path(spark, "windows")
    texts.mapInArrow(_window_blocks(tokens, gram, length, hot_bits, filter_bits), _BLOCK).write.parquet(path)
    blocks = spark.read.parquet(path)
    n = blocks.agg(F.sum("n")).first()[0] or 0
    asked = blocks.select("block", "which", "windows").mapInArrow(_windows_asked((n // _SHARD_WINDOWS).bit_length()), "shard int, block long, windows binary, twice binary")
    answers = asked.groupBy("shard").applyInArrow(_windows_answered, "block long, shard int, n long, bits binary")
    return blocks.drop("n").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_window_spans(length), "key long, start long, stop long")


# What an index does: stretches, whether each stands in several places, and the window length in tokens,
# to, for each stretch, the offsets at which a repeated window starts.
Index = Callable[[list[bytes], list[bool], int], list[np.ndarray]]


def _spans(offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts and ends of the tokens covered by windows that start at the sorted offsets."""
    cut = np.flatnonzero(np.diff(offsets) > 1)
    firsts = offsets[np.concatenate(([0], cut + 1))]
    lasts = offsets[np.concatenate((cut, [len(offsets) - 1]))]
    return np.stack((firsts, lasts + length), axis=1)


def _indexer(index: Index, length: int, index_bytes: int):
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def indexed(groups: dict[bytes, tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
        repeated = index(list(groups), [len(keys) > 1 for keys, _ in groups.values()], length)
        keys, starts, stops = [], [], []
        for (own, places), offsets in zip(groups.values(), repeated, strict=True):
            if len(offsets):
                spans = _spans(offsets, length)
                at = np.asarray(places)
                keys.append(np.repeat(np.asarray(own), len(spans)))
                starts.append((at[:, None] + spans[:, 0]).ravel())
                stops.append((at[:, None] + spans[:, 1]).ravel())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, starts, stops)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, tuple[list[int], list[int]]] = {}
        size, last = 0, None
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("gram", "content", "keys", "places"))
            for gram, content, keys, places in zip(*columns, strict=True):
                if gram != last:
                    if size >= index_bytes:
                        yield from indexed(groups)
                        groups, size = {}, 0
                    last = gram
                if content in groups:
                    groups[content][0].extend(keys)
                    groups[content][1].extend(places)
                else:
                    groups[content] = (keys, places)
                    size += len(content)
        if groups:
            yield from indexed(groups)

    return run


def repeated_spans(
    texts: DataFrame, tokens: Tokens, index: Index, gram: int, length: int,
    hot: int = HOT, filter_bits: int = FILTER_BITS, index_bytes: int = _INDEX_BYTES,
) -> DataFrame:
    """``key, spans``: the token spans of each text that repeated windows cover, unmerged; only texts that have some.

    ``texts`` has ``key long, text string``. Rows that are equal count as several
    texts, and each repeats the other; their spans come under one key.
    """
    spark: SparkSession = texts.sparkSession
    texts = texts.select("key", "text")
    counts = (
        texts.mapInArrow(_gram_counter(tokens, gram, length), "gram long, n long")
        .groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    )
    slot = F.col("gram").bitwiseAND(F.lit(filter_bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = counts.select(
        F.shiftright(slot, 6).alias("word"), bit.alias("bit"), F.when(F.col("n") > hot, bit).otherwise(F.lit(0).cast("long")).alias("hot")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"), F.bit_or("hot").alias("hot"))
    told = words.toPandas()
    marked = np.zeros(filter_bits // 64, np.uint64)
    marked[told["word"].to_numpy(np.int64)] = told["bits"].to_numpy(np.int64).view(np.uint64)
    hot_marked = np.zeros(filter_bits // 64, np.uint64)
    hot_marked[told["word"].to_numpy(np.int64)] = told["hot"].to_numpy(np.int64).view(np.uint64)
    context = spark.sparkContext
    bits, hot_bits = context.broadcast(marked.tobytes()), context.broadcast(hot_marked.tobytes())
    some_hot = bool(hot_marked.any())
    del told, marked, hot_marked
    found = texts.mapInArrow(_stretch_finder(tokens, gram, length, bits, hot_bits, filter_bits), "gram long, content binary, keys array<long>, places array<long>")
    dealt = found.repartition("gram").sortWithinPartitions("gram")
    spans = dealt.mapInArrow(_indexer(index, length, index_bytes), "key long, start long, stop long")
    if some_hot:
        spans = spans.unionByName(_counted_spans(texts, tokens, gram, length, hot_bits, filter_bits))
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of the given spans."""
    runs: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    return [(a, b) for a, b in runs]
