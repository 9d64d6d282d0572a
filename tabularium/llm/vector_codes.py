"""Product codes of vectors by Lloyd's algorithm on resident members.

A vector is cut in parts of equal length, and every part position has a codebook. The
members of a codebook entry live with its *owners*: a part is kept in the partition
of (position, entry, salt), where the salt spreads a large entry over as many owners
as its size asks for. In each round

1. owners sum up their resident members; per partition one sum for each entry at
   most leaves for the new codebooks, which are small whatever the number of vectors;
2. owners assign their residents anew. Parts that stay with their owner stay where
   they are; only those whose entry changed (or whose entry has grown beyond its
   owners) go through the shuffle to their new owner.

What stays and what arrives have one partitioner, so they are put together without
moving. That is what the RDD interface is for here: a DataFrame would deal all
members out again. Records are whole arrays of parts, not single ones. Every second
state is checkpointed; the rounds between can be worked out again from there.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.registry import contract, read
from tabularium.llm.words import mixed
from tabularium.session import shared_root, shared_path

POSITIONS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Parts in a partition, about, and distances worked out at once.
PARTITION_PARTS = 1 << 18
_CHUNK = 1 << 13
# Beyond this a squared distance may not fit 64 bits.
LIMIT = 1 << 25
_CHECKPOINT_EVERY = 2


# Parts of vectors are tuples of arrays: row numbers, part positions, codebook entries, and the components, one row each.
Parts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def taken(parts: Parts, chosen: np.ndarray) -> Parts:
    return tuple(column[chosen] for column in parts)


def together(parts: list[Parts]) -> Parts:
    return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def nearest(values: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The nearest entry of each row by squared distance, ties to the lower one; exact."""
    entries = np.zeros(len(values), np.int64)
    width = values.shape[1]
    peak = max(int(np.abs(values).max(initial=0)), int(np.abs(codebook).max(initial=0)))
    # Whole numbers below 2^53 are exact as doubles.
    small = 4 * width * peak * peak < 1 << 53
    step = _CHUNK if small else max(1, _CHUNK // max(1, width))
    for at in range(0, len(values), step):
        block = values[at : at + step].astype(np.float64 if small else np.int64)
        if small:
            book = codebook.astype(np.float64)
            squared = (block * block).sum(1)[:, None] - 2 * (block @ book.T) + (book * book).sum(1)[None, :]
        else:
            squared = ((block[:, None, :] - codebook[None, :, :]) ** 2).sum(2)
        entries[at : at + step] = squared.argmin(1)
    return entries


def assigned(parts: Parts, codebooks: list[np.ndarray]) -> Parts:
    """The parts with their nearest entries."""
    row, position, entry, values = parts
    entry = entry.copy()
    for at, book in enumerate(codebooks):
        own = np.flatnonzero(position == at)
        entry[own] = nearest(values[own][:, : book.shape[1]], book)
    return row, position, entry, values


def distances(parts: Parts, codebooks: list[np.ndarray]) -> np.ndarray:
    """Squared distance of each part to its entry."""
    _, position, entry, values = parts
    out = np.zeros(len(entry), np.int64)
    for at, book in enumerate(codebooks):
        own = np.flatnonzero(position == at)
        out[own] = ((values[own][:, : book.shape[1]] - book[entry[own]]) ** 2).sum(1)
    return out


def _places(parts: Parts) -> np.ndarray:
    return parts[1].astype(np.int64) * ENTRIES + parts[2]


def _owners(parts: Parts, spread: np.ndarray) -> np.ndarray:
    """A number for the owner (position, entry, salt) of each part; ``spread`` has a power of two of owners for each entry."""
    place = _places(parts)
    salt = mixed(parts[0].astype(np.uint64)) & (spread[place] - 1).astype(np.uint64)
    return (mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(1)).astype(np.int64)


def _owner_partition(owner: int) -> int:
    return owner


def _sent(parts: Parts, owners: np.ndarray, n: int) -> Iterator[tuple[int, Parts]]:
    """Parts by the partition of their owner, one record for each."""
    to = owners % n
    order = np.argsort(to, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            yield int(to[order[a]]), taken(parts, order[a:b])


def _cut(bounds: np.ndarray):
    """Rows of whole-number vectors to records of parts."""
    width = int(np.diff(bounds).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, int(bounds[-1]))
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for position, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                values = np.zeros((n, width), np.int64)
                values[:, : b - a] = vectors[:, a:b]
                values = values.astype(np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int32)
                made = (rows, np.full(n, position, np.int8), np.zeros(n, np.int16), values)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["parts"])

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of assigned parts and distances to rows."""
    for batch in batches:
        for data in batch.column("parts").to_pylist():
            (row, position, entry, _), far = pickle.loads(data)
            columns = [pa.array(row, pa.int64()), pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "position", "entry", "distance"])


def _sums(members: Parts) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
    """Count and componentwise sum of the members of each (position, entry) here."""
    place = _places(members)
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[order], prepend=-1))
    if len(edges):
        sums = np.add.reduceat(members[3][order].astype(np.int64), edges, axis=0)
        counts = np.diff(np.append(edges, len(order)))
        yield from zip(place[order][edges].tolist(), zip(counts.tolist(), sums, strict=True), strict=True)


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def _spread(counts: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
    """Owners of each entry, a power of two: none should have more than an eighth of an even partition's members, and none is given up."""
    most = max(1.0, counts.sum() / (8 * n))
    spread = 1 << np.ceil(np.log2(np.maximum(1, counts / most))).astype(np.int64)
    return spread if before is None else np.maximum(spread, before)


def lloyd(
    spark: SparkSession, staged: DataFrame, codebooks: list[np.ndarray], bounds: np.ndarray, rounds: int, partition_parts: int
) -> tuple[RDD, list[np.ndarray], list[RDD]]:
    """Records of parts with their last entries and distances, the last codebooks, and what to unpersist once the records are used.

    ``staged`` has ``row long, vector array<long>``. What the driver gets per round is
    a count and a sum for each codebook entry.
    """
    context = spark.sparkContext
    shared_root(spark)
    n = max(context.defaultParallelism, -(-staged.count() * (len(bounds) - 1) // partition_parts))
    unplaced = staged.select("row", "vector").mapInArrow(_cut(bounds), "parts binary").rdd.map(lambda r: pickle.loads(r["parts"]))
    books = context.broadcast(codebooks)

    def counted(parts: Parts) -> Iterator[tuple[int, int]]:
        at, many = np.unique(_places(parts), return_counts=True)
        return zip(at.tolist(), many.tolist(), strict=True)

    def members(records: Iterator[tuple[int, Parts]]) -> Iterator[tuple[int, Parts]]:
        """The residents of a partition as one record."""
        own = list(records)
        if own:
            yield own[0][0], together([parts for _, parts in own])

    first = unplaced.map(lambda parts, books=books: assigned(parts, books.value)).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = np.zeros((len(bounds) - 1) * ENTRIES, np.int64)
    for at, many in first.flatMap(counted).reduceByKey(lambda a, b: a + b).collect():
        sizes[at] = many
    spread = _spread(sizes, n)
    dealt = first.flatMap(lambda parts, spread=spread: _sent(parts, _owners(parts, spread), n)).partitionBy(n, _owner_partition)
    state, old = dealt.mapPartitions(members, preservesPartitioning=True), [first]
    for turn in range(rounds):
        state.persist(StorageLevel.MEMORY_AND_DISK)
        if turn % _CHECKPOINT_EVERY == 0:
            state.checkpoint()
        sums = dict(state.flatMap(lambda record: _sums(record[1])).reduceByKey(_added).collect())
        for one in old:
            one.unpersist()
        codebooks = [book.copy() for book in codebooks]
        sizes = np.zeros_like(sizes)
        for at, (many, total) in sums.items():
            position, entry = divmod(at, ENTRIES)
            codebooks[position][entry] = np.floor_divide(total[: codebooks[position].shape[1]], many)
            sizes[at] = many
        books, before = context.broadcast(codebooks), spread
        spread = _spread(sizes, n, before)

        def moved(records: Iterator[tuple[int, Parts]], books=books, before=before, spread=spread) -> Iterator[tuple[int, tuple[bool, Parts]]]:
            for at, parts in records:
                now = assigned(parts, books.value)
                stays = (now[2] == parts[2]) & (_owners(now, spread) == _owners(parts, before))
                yield at, (True, taken(now, np.flatnonzero(stays)))
                leaving = taken(now, np.flatnonzero(~stays))
                for to, some in _sent(leaving, _owners(leaving, spread), n):
                    yield to, (False, some)

        # Keyed by where the parts live until the movers are dealt out.
        split = state.mapPartitions(moved, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        staying = split.filter(lambda record: record[1][0]).mapValues(lambda value: value[1])
        movers = split.filter(lambda record: not record[1][0]).mapValues(lambda value: value[1]).partitionBy(n, _owner_partition)
        old = [state, split]
        state = staying.union(movers).mapPartitions(members, preservesPartitioning=True)
    return state.map(lambda record, books=books: (record[1], distances(record[1], books.value))), codebooks, old


def spelled_codebooks(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(int(x)) for book in codebooks for x in book.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS,
    partition_parts: int = PARTITION_PARTS,
) -> DataFrame:
    """Codes of all vectors: ``id, code, error, label_error, codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite components are dropped.
    Components become floor(1024 * x). The codebooks start as the parts of the 256
    rows with the smallest ids (fewer if there are fewer rows), nulls last, ties by
    the vector. A vector is cut in four parts; if its length is no multiple of four the
    parts differ by one. Repeated rows are rows of their own. A vector of another
    length than that of the first id's, or with a component of 32 768 or more, has
    no code: its code and error are null, and it counts nowhere. ``label_error`` sums
    the errors of equal labels, nulls together. An empty table gives no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("raw"), F.col(label_column).alias("label"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    path = shared_path(spark, "vectors")
    # Numbered and written once: all later steps mean the same rows.
    rows.filter(F.col("raw").isNotNull() & finite).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    in_order = [F.col("id").asc_nulls_last(), "raw"]
    one = kept.orderBy(*in_order).limit(1).select(F.size("raw").alias("n")).first()
    length = one["n"] if one else 0
    staged = kept.filter((F.size("raw") == length) & F.forall("raw", lambda x: F.abs(x) < LIMIT // SCALE))
    whole = F.transform("raw", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vector")
    starts = [r["vector"] for r in staged.orderBy(*in_order).limit(ENTRIES).select(whole).collect()]
    staged = staged.select("row", whole)
    out = kept.select("row", "id", "label")
    if starts:
        bounds = np.linspace(0, length, POSITIONS + 1).astype(np.int64)
        first = np.array(starts, np.int64).reshape(len(starts), length)
        records, codebooks, held = lloyd(spark, staged, [first[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], bounds, rounds, partition_parts)
        digest = spelled_codebooks(codebooks)
        told = spark.createDataFrame(records.map(lambda record: (pickle.dumps(record),)), "parts binary").mapInArrow(_told, "row long, position int, entry int, distance long")
        pair = F.lower(F.lpad(F.hex("entry"), 2, "0"))
        codes = told.groupBy("row").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", pair.alias("pair")))), lambda p: p["pair"]), "").alias("code"),
            F.sum("distance").alias("error"),
        )
        out = out.join(codes, "row", "left")
        # Summed up twice otherwise, and all rounds before with it.
        path = shared_path(spark, "codes")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        for rdd in held:
            rdd.unpersist()
    else:
        digest = spelled_codebooks([])
        out = out.select("*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("unlabelled", F.col("label").isNull())
    by_label = by_label.select("unlabelled", F.coalesce("label", F.lit(0).cast(out.schema["label"].dataType)).alias("of"), "label_error")
    keyed = out.withColumns({"unlabelled": F.col("label").isNull(), "of": F.coalesce("label", F.lit(0).cast(out.schema["label"].dataType))})
    return keyed.join(by_label, ["unlabelled", "of"]).select(
        F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


@contract("op11_vector_codes")
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress(read(spark, folder, "embeddings"))
