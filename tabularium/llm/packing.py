"""Best-fit packing of documents into token sequences, by bin completion.

How full sequences can get depends on the lengths of the pieces only, and there
are no more lengths than tokens in a sequence. So the search runs on the
histogram of lengths, which has a fixed size however many documents there are,
and yields *fillings* with the number of times each is used. Spark then deals the
pieces of each length over the fillings by their rank.

The search is bin completion with branch and bound: it takes the longest piece
left, lists the undominated ways to fill the rest of its sequence, those with
least waste first, and goes down each. A branch ends when the waste so far
exceeds what a solution better than the incumbent could afford. Best-fit
solutions of what is left are the incumbents. A filling without waste is used as
often as the histogram allows.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm.registry import contract, read, row_key
from tabularium.session import shared_path

CAPACITY = 1024
# Fixed value: the id that ends each document.
END_ID = 2

# Nodes the search may open before it settles for its incumbent, and fillings listed at each.
NODES = 3000
WIDTH = 8
# Steps in the listing of fillings at one node, and nodes from one best-fit solution to the next.
_STEPS = 300
_BETWEEN = 64

Filling = tuple[tuple[int, int], ...]


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram, ``counts[length]``; fillings as ``((length, times), ...)``."""
    capacity = len(counts) - 1
    left = counts.copy()
    rooms: list[list[list]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        room = size
        while left[size] and room <= capacity:
            if not rooms[room]:
                room += 1
                continue
            filling, bins = rooms[room].pop()
            used = min(bins, int(left[size]))
            if used < bins:
                rooms[room].append([filling, bins - used])
            left[size] -= used
            grown = (*filling[:-1], (size, filling[-1][1] + 1)) if filling[-1][0] == size else (*filling, (size, 1))
            rooms[room - size].append([grown, used])
            room = max(size, room - size) if room - size >= size else room
        if left[size]:
            each = capacity // size
            whole, rest = divmod(int(left[size]), each)
            for times, bins in ((each, whole), (rest, 1)):
                if times and bins:
                    rooms[capacity - size * times].append([((size, times),), bins])
    return [(filling, bins) for room in rooms for filling, bins in room]


def bins_of(plan: list[tuple[Filling, int]]) -> int:
    return sum(times for _, times in plan)


def lower_bound(counts: np.ndarray) -> int:
    """The most of the volume bound and Martello and Toth's bound over all thresholds."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    best = ceil(int(volume[-1]) / capacity)
    for k in range(capacity // 2 + 1):
        large = int(number[-1] - number[capacity - k])
        middle = int(number[capacity - k] - number[capacity // 2])
        filled = int(volume[capacity - k] - volume[capacity // 2])
        small = int(volume[capacity // 2] - (volume[k - 1] if k else 0))
        best = max(best, large + middle + max(0, ceil((small - (middle * capacity - filled)) / capacity)))
    return best


def completions(counts: np.ndarray, room: int, allowed: int) -> list[tuple[int, Filling]]:
    """Undominated fillings of ``room`` with waste of at most ``allowed``, least waste first, ``WIDTH`` at most.

    A filling is dominated if a piece still fits beside it, or if a longer piece
    could take the place of one or two of its pieces.
    """
    found: list[tuple[int, Filling]] = []
    sizes = np.flatnonzero(counts)
    steps = [_STEPS]

    def longest(limit: int) -> int:
        at = int(np.searchsorted(sizes, limit, "right")) - 1
        return int(sizes[at]) if at >= 0 else 0

    def dominated(chosen: list[tuple[int, int]], waste: int) -> bool:
        pieces = [size for size, times in chosen for _ in range(min(times, 2))]
        groups = {(x,) for x in pieces} | {(x, y) for i, x in enumerate(pieces) for y in pieces[i + 1 :]} if len(pieces) <= 12 else {(x,) for x in pieces}
        used = dict(chosen)
        for group in groups:
            size = longest(sum(group) + waste)
            if size > group[0] and size >= sum(group) and counts[size] > used.get(size, 0):
                return True
        return False

    def down(limit: int, left: int, chosen: list[tuple[int, int]]) -> None:
        steps[0] -= 1
        size = longest(min(limit, left))
        if not size:
            if left <= allowed and not dominated(chosen, left):
                found.append((left, tuple(chosen)))
            return
        tried = 0
        while size and steps[0] > 0 and len(found) < 8 * WIDTH and sum(not waste for waste, _ in found) < 2:
            for times in range(min(int(counts[size]), left // size), 0, -1):
                down(size - 1, left - size * times, [*chosen, (size, times)])
            tried += 1
            size = longest(size - 1)
            if tried >= WIDTH:
                break

    down(room, room, [])
    return sorted(set(found), key=lambda x: (x[0], [-s for s, _ in x[1]]))[:WIDTH]


def pack_lengths(counts: np.ndarray, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, in as few sequences as the search finds."""
    capacity = len(counts) - 1
    counts = counts.astype(np.int64)
    volume = int((counts * np.arange(capacity + 1)).sum())
    incumbent, least = best_fit(counts), lower_bound(counts)
    best = bins_of(incumbent)
    # A node is what is left, the fillings used so far, their number and their waste.
    stack = [(counts, None, 0, 0)]
    while stack and best > least and nodes:
        left, chain, used, waste = stack.pop()
        affordable = (best - 1) * capacity - volume - waste
        if affordable < 0:
            continue
        nodes -= 1
        present = np.flatnonzero(left)
        if not len(present):
            if used < best:
                incumbent, best = _unrolled(chain), used
            continue
        if nodes % _BETWEEN == 0 or len(present) < _BETWEEN:
            rest = best_fit(left)
            if used + bins_of(rest) < best:
                incumbent, best = _unrolled(chain) + rest, used + bins_of(rest)
                affordable = (best - 1) * capacity - volume - waste
        top = int(present[-1])
        one = left.copy()
        one[top] -= 1
        branches = []
        for lost, filling in completions(one, capacity - top, affordable):
            pieces = dict(filling)
            pieces[top] = pieces.get(top, 0) + 1
            times = min(int(left[size]) // n for size, n in pieces.items())
            times = max(1, min(times, affordable // lost) if lost else times)
            after = left.copy()
            for size, n in pieces.items():
                after[size] -= n * times
            whole = tuple(sorted(pieces.items(), reverse=True))
            branches.append((after, (chain, whole, times), used + times, waste + lost * times))
        stack += reversed(branches)
    return incumbent


def _unrolled(chain) -> list[tuple[Filling, int]]:
    plan = []
    while chain is not None:
        chain, filling, times = chain
        plan.append((filling, times))
    return plan


# The pre-tokens of the vocabulary, for texts in which this library's classes agree with Unicode's.
_PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


# White space beyond ASCII, as Unicode has it.
_OTHER_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Token ids as little-endian 32-bit bytes, equal to those of the ``tokenizers`` library for a byte-level vocabulary.

    Words recur, so ids are kept per word; what is new is encoded from the same
    vocabulary's ranks. Texts with the special token's string, or with characters
    that the two libraries may class differently, go to ``tokenizers`` as a whole.
    """

    _KEPT = 250_000

    def __init__(self, vocabulary: str, ranks: str, pattern: str, special: str):
        import sys
        import unicodedata

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        odd = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No") or (c.isalnum() and unicodedata.category(c)[0] not in "LN")]
        self.special, self.odd = special, frozenset([*"\x1c\x1d\x1e\x1f", *odd])
        # A line of words with single spaces, and nothing else white.
        self.simple = re.compile(r"\S+(?: \S+)*")
        # By piece, and by word for words with a space before.
        self.kept: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _new(self, piece: str, spaced: bool) -> bytes:
        kept = self.kept[spaced]
        if len(kept) >= self._KEPT:
            kept.clear()
        ids = kept[piece] = array("I", self.encoding.encode_ordinary(" " + piece if spaced else piece)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if self.special in text or not self.odd.isdisjoint(set(text)):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        plain, spaced = self.kept[0].get, self.kept[1].get
        lines = text.split("\n")
        if (not text.isascii() and any(c in text for c in _OTHER_SPACE)) or not all(map(self.simple.fullmatch, lines)):
            return b"".join([plain(piece) or self._new(piece, False) for piece in _PRE_TOKEN.findall(text)])
        # A space belongs to the word after it and a line break to none, so that words can be encoded one by one.
        out = []
        for line in lines:
            first, *rest = line.split(" ")
            out.append(plain(first) or self._new(first, False))
            out += [spaced(word) or self._new(word, True) for word in rest]
            out.append(plain("\n") or self._new("\n", False))
        out.pop()
        return b"".join(out)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(paths: tuple[str, str, str, str]) -> Encoder:
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def public_vocabulary() -> tuple[str, str, str, str]:
    """Files of the public byte-level vocabulary, its pre-token pattern, and its special token."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<|endoftext|>"


def _cutter(paths, capacity: int, end_id: int):
    names = ("piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(paths)
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows, values = [], []
            for i, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py() or "") + last
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - at - 1) % capacity + 1
                    values.append((piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    rows.append(i)
                    at, piece = at + length, piece + 1
            table = list(zip(*values, strict=True)) or [()] * 4
            columns = [pa.array(table[0], pa.int32()), *[pa.array(c, pa.int64()) for c in table[1:]]]
            kept = [batch.column(name).take(pa.array(rows, pa.int64())) for name in ("id", "key")]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["id", "key", *names])

    return run


def cut_documents(documents: DataFrame, id_column: str, text_column: str, paths=None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id, key, piece, start, length, ids_crc32``: documents as token pieces; only those over ``capacity`` are cut, the first piece the shorter."""
    documents = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    documents = documents.withColumn("key", row_key(F.col("id"), F.col("text")))
    kind = dict(documents.dtypes)["id"]
    return documents.mapInArrow(
        _cutter(paths or public_vocabulary(), capacity, end_id), f"id {kind}, key long, piece int, start long, length long, ids_crc32 long"
    )


def _dealer(firsts: np.ndarray, table: np.ndarray):
    """Sequence and offset of the n-th piece of a length, by the part of the plan that its number falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = firsts[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            part = table[np.searchsorted(table[:, 0], number, "right") - 1]
            inside = number - part[:, 0]
            sequence = part[:, 1] + inside // part[:, 2]
            offset = part[:, 3] + (inside % part[:, 2]) * batch.column("length").to_numpy()
            others = [name for name in batch.schema.names if name not in ("key", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in others), pa.array(sequence), pa.array(offset)], names=[*others, "sequence_id", "offset"]
            )

    return run


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``id, key, piece, length``; drops ``key``.

    What the driver holds is the histogram and the plan made of it. Pieces of one
    length are numbered in slices by the hash of their document, so that no
    length, however common, is numbered by one task.
    """
    spark = pieces.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("key", "piece"), F.lit(slices)).cast("int"))
    sliced = pieces.groupBy("length", "slice").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in sliced.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    taken, table, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for filling, times in pack_lengths(counts, nodes):
        offset = 0
        for size, n in filling:
            table.append((firsts[size] + taken[size], sequence, n, offset))
            taken[size] += n * times
            offset += size * n
        sequence += times
    plan = np.array(sorted(table), np.int64).reshape(-1, 4)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "slice").orderBy("key", "piece")
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside")).drop("slice", "before", "inside")
    fields = ", ".join(f"{name} {kind}" for name, kind in ranked.dtypes if name not in ("key", "rank"))
    return ranked.mapInArrow(_dealer(firsts, plan), f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", paths=None, capacity: int = CAPACITY) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``: every document's tokens in sequences of at most ``capacity``.

    Null and empty texts are the end id alone. Equal rows are packed each. An
    empty table gives no rows. Columns other than the id and the text are not read.
    """
    spark = documents.sparkSession
    path = shared_path(spark, "pieces")
    cut_documents(documents, id_column, text_column, paths, capacity).write.parquet(path)
    placed = place_pieces(spark.read.parquet(path), capacity)
    return placed.select(
        F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@contract("op3_bin_completion")
def op3_bin_completion(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"))
