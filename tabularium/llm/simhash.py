"""Benchmark decontamination: SimHash of item-sized windows.

1. Shingles of the items, together with the size of their item, set bits in a
   filter of a fixed number of bits. A window of a document as long as an item can
   only be as similar as asked if it holds so many of the shingles of items of that
   length; the filter tells at least those, so windows with fewer are settled. This
   drops no window that counts, and leaves few. A document with fewer words than an
   item has one window for that length, the whole document, unless it is too short
   to be as similar as asked.
2. The windows left, and the items, get a 64-bit SimHash: the sign, per bit, of the
   sum over the weighted shingles. Fingerprints are cut in blocks; two within a
   radius agree in some block up to the radius divided by the number of blocks, so a
   join on the blocks of the windows and all such neighbours of the blocks of the
   items finds every pair within the radius.
3. Pairs within the radius are verified by the exact weighted Jaccard similarity of
   their shingles, each counted as often as it stands there.

Equal windows are fingerprinted, joined and verified once, however many documents
hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.bagminhash import overlap
from tabularium.llm.registry import contract, read, row_key
from tabularium.llm.words import mixed, plain_words, rolling, texts_of
from tabularium.session import shared_path

# Words of a shingle; items with fewer words are one shingle as a whole.
SHINGLE = 5
SIMILARITY = 0.8
# Bits of the filter of item shingles; its size does not depend on the input.
FILTER_BITS = 1 << 24
# Blocks of 8 bits, and the radius. A window of similarity 0.8 differs from its item in
# less than 10 bits on average, with a standard deviation below 3.
BLOCKS = 8
RADIUS = 23

_SIZE = 0x9E6C63D0876A9A43


def _sized(shingles: np.ndarray, size: int) -> np.ndarray:
    """Shingle hashes that also tell the size of the item or window that they are of."""
    return mixed(shingles ^ np.uint64(size * _SIZE % (1 << 64)))


def _gram(size: int) -> int:
    return min(SHINGLE, size)


def least_shared(size: int, similarity: float = SIMILARITY, words: int | None = None) -> int:
    """How many shingles an item of ``size`` words and a run of ``words`` (as many, if not given) share at least if they are that similar."""
    shingles = size + (size if words is None else words) - 2 * (_gram(size) - 1)
    return max(1, int(np.ceil(similarity / (1 + similarity) * shingles - 1e-9)))


def simhash(shingles: np.ndarray) -> int:
    """The 64 signs, as a signed long, of the sums of the shingles' bits; repeated shingles weigh as often."""
    bits = (mixed(shingles)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    signs = 2 * bits.sum(axis=0).astype(np.int64) > len(shingles)
    return int(np.packbits(signs, bitorder="little").view(np.int64)[0])


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, size, print, shingles`` of items with words."""
    for keys, texts in texts_of(batches, "id"):
        words, bounds = plain_words(texts)
        rows = []
        for i, key in enumerate(keys):
            own = words[bounds[i] : bounds[i + 1]]
            if len(own):
                shingles = _sized(rolling(own, _gram(len(own))), len(own))
                rows.append((key, len(own), simhash(shingles), shingles.view(np.int64)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64()))],
            names=["id", "size", "print", "shingles"],
        )


def _window_rows(any_bits, sized_bits, sizes: list[int], filter_bits: int, similarity: float):
    """``key, start, size, words, print, shingles`` of the windows of so many words that may be similar to an item of that size."""
    least = {size: least_shared(size, similarity) for size in sizes}
    mask = np.uint64(filter_bits - 1)

    def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        slots = hashes & mask
        return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_sized = (np.frombuffer(b.value, np.uint64) for b in (any_bits, sized_bits))
        for keys, texts in texts_of(batches):
            words, bounds = plain_words(texts)
            out: dict[str, list] = {name: [] for name in ("key", "start", "size", "words", "print", "shingles")}

            def add(text: int, start: int, size: int, n: int, window: np.ndarray) -> None:
                for column, value in zip(out.values(), (keys[text], start, size, n, simhash(window), window.view(np.int64)), strict=True):
                    column.append(value)

            for gram in sorted({_gram(size) for size in sizes}):
                if len(words) < gram:
                    continue
                shingles = rolling(words, gram)
                places = np.flatnonzero(held(known, mixed(shingles)))
                if not len(places):
                    continue
                for size in (s for s in sizes if _gram(s) == gram):
                    own = places[held(known_sized, _sized(shingles[places], size))]
                    many = least[size]
                    if len(own) < many:
                        continue
                    width = size - gram + 1
                    # Starts of windows around enough of the places: between the first and last window to hold a run of them.
                    starts = np.unique(np.concatenate([own - shift for shift in range(width)]))
                    starts = starts[(starts >= 0) & (starts + size <= len(words))]
                    count = np.searchsorted(own, starts + width) - np.searchsorted(own, starts)
                    starts = starts[count >= many]
                    owner = np.searchsorted(bounds, starts, "right") - 1
                    inside = starts + size <= bounds[owner + 1]
                    for start, text in zip(starts[inside].tolist(), owner[inside].tolist(), strict=True):
                        add(text, start - int(bounds[text]), size, size, _sized(shingles[start : start + width], size))
                # Documents shorter than an item, as a whole.
                long = [s for s in sizes if _gram(s) == gram]
                lengths, lasts = np.diff(bounds), bounds[1:] - gram + 1
                told = np.searchsorted(places, lasts) > np.searchsorted(places, bounds[:-1])
                for text in np.flatnonzero(told & (lengths >= gram) & (lengths < long[-1])).tolist():
                    n, whole = int(lengths[text]), shingles[bounds[text] : lasts[text]]
                    for size in (s for s in long if s > n):
                        many = least_shared(size, similarity, n)
                        if many > len(whole):
                            break
                        window = _sized(whole, size)
                        if held(known_sized, window).sum() >= many:
                            add(text, 0, size, n, window)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def block_keys(fingerprint: np.ndarray, size: np.ndarray, near: int) -> list[list[int]]:
    """Per fingerprint the keys of all values that differ from its blocks in at most ``near`` bits, marked by block and size."""
    masks = [sum(1 << bit for bit in bits) for n in range(near + 1) for bits in combinations(range(64 // BLOCKS), n)]
    out = []
    for value, n in zip(fingerprint.view(np.uint64).tolist(), size.tolist(), strict=True):
        parts = [(value >> (8 * b)) & 0xFF for b in range(BLOCKS)]
        out.append([((n * BLOCKS + b) << 8) | (part ^ mask) for b, part in enumerate(parts) for mask in masks])
    return out


def _keyed(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = block_keys(batch.column("print").to_numpy(), batch.column("size").to_numpy(), near)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "blocks"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def bag(shingles: list[int]):
        return np.unique(np.asarray(shingles, np.int64), return_counts=True)

    for batch in batches:
        pairs = zip(batch.column("window").to_pylist(), batch.column("item").to_pylist(), strict=True)
        found = pa.array([overlap(bag(a), bag(b)) for a, b in pairs], pa.float64())
        kept = [name for name in batch.schema.names if name not in ("window", "item")]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), found], names=[*kept, "similarity"])


def _bitmap(hashes: DataFrame, filter_bits: int) -> bytes:
    """The filter with the bits of a column ``hash`` set; gathered as words of 64 bits, as many as the filter has at most."""
    slot = F.col("hash").bitwiseAND(F.lit(filter_bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    told = hashes.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(filter_bits // 64, np.uint64)
    words[told["word"].to_numpy(np.int64)] = told["bits"].to_numpy(np.int64).view(np.uint64)
    return words.tobytes()


def contaminated(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``id, key, item_id, start, n_words, hamming, similarity``: one row per document and item found in it.

    Words are of letters and digits, A-Z lower-cased. The row tells the most
    similar window of the item's length, the first of several; a document with fewer
    words than the item is one window, of ``n_words`` words. ``key`` tells
    documents with one id and different texts apart; equal rows give one row. Null
    and empty texts, and items without words, match nothing; items of fewer than
    ``SHINGLE`` words match where all their words stand. Rows without an item id
    are not items.
    """
    spark = documents.sparkSession
    context = spark.sparkContext
    documents = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    keyed = documents.withColumn("key", row_key(F.col("id"), F.col("text")))
    items = benchmark.select(F.col(item_column).cast("long").alias("id"), F.col(item_text_column).alias("text")).filter(F.col("id").isNotNull())
    items = items.mapInArrow(_item_rows, "id long, size int, print long, shingles array<long>")
    # One entry per length of an item, in words.
    sizes = sorted(row["size"] for row in items.select("size").distinct().collect())
    bare = benchmark.select(F.lit(0).cast("long").alias("id"), F.col(item_text_column).alias("text"))
    any_bits = context.broadcast(_bitmap(bare.mapInArrow(_plain_shingles, "hash long"), filter_bits))
    sized_bits = context.broadcast(_bitmap(items.select(F.explode("shingles").alias("hash")), filter_bits))
    finder = _window_rows(any_bits, sized_bits, sizes, filter_bits, similarity)
    windows = keyed.select("key", "text").mapInArrow(finder, "key long, start long, size int, words int, print long, shingles array<long>")
    path = shared_path(spark, "windows")
    windows.withColumn("content", F.xxhash64("shingles")).write.parquet(path)
    windows = spark.read.parquet(path)
    contents = windows.groupBy("size", "print", "content").agg(F.first("shingles").alias("window"))
    exact = contents.select("size", "print", "content").mapInArrow(_keyed(0), "size int, print long, content long, blocks array<long>")
    around = items.select("id", "size", "print").mapInArrow(_keyed(radius // BLOCKS), "id long, size int, print long, blocks array<long>")
    exact = exact.select("size", "print", "content", F.explode("blocks").alias("block"))
    around = around.select(F.col("id").alias("item_id"), F.col("print").alias("item_print"), F.explode("blocks").alias("block"))
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = exact.join(around, "block").withColumn("hamming", hamming).filter(F.col("hamming") <= radius)
    pairs = pairs.select("size", "print", "content", "item_id", "hamming").distinct()
    both = pairs.join(contents, ["size", "print", "content"]).join(items.select(F.col("id").alias("item_id"), "size", F.col("shingles").alias("item")), ["item_id", "size"])
    verified = both.select("size", "print", "content", "item_id", "hamming", "window", "item").mapInArrow(
        _similar, "size int, print long, content long, item_id long, hamming int, similarity double"
    )
    verified = verified.filter(F.col("similarity") >= similarity)
    places = windows.select("key", "start", "size", "words", "print", "content").join(verified, ["size", "print", "content"])
    best = places.groupBy("key", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start", "words", "hamming")).alias("best"))
    ids = keyed.select("key", "id").distinct()
    return best.join(ids, "key").select(
        F.col("id").alias(id_column), "key", "item_id", "best.start", F.col("best.words").alias("n_words"), "best.hamming", (-F.col("best.less")).alias("similarity")
    )


def _plain_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in texts_of(batches, "id"):
        words, bounds = plain_words(texts)
        found = [np.zeros(0, np.uint64)]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if last > first:
                found.append(mixed(rolling(words[first:last], _gram(int(last - first)))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["hash"])


@contract("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("key")
