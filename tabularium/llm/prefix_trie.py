"""A trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns; the root has none. Conversations are
sorted by the digests of their turns, so that the members of a node stand side by
side, and cut in shards of a like number of conversations; copies of one
conversation may lie in several. In a shard the sorted conversations are compared
with their neighbours only, which names each distinct node once.

Totals then go up in reverse level order. The nodes of a shard are sorted by falling
depth (by Spark, which spills); each takes the messages that its children sent it out
of a priority queue in the same order, adds its own share and sends the sum to its
parent. The queue keeps a bounded number of messages and spills the rest as sorted
runs. Nodes on the path of a shard's first or last conversation may have members in
other shards: they stay *open* and only gather. All others are done.

Open nodes of neighbouring shards meet in the next round: a group of ``FAN`` shards
is one range of conversations, its open nodes are merged and processed in the same
way, and those at the ends of the group's range stay open. Rounds go on until one
group holds all, so their number is the logarithm of the number of shards, and a
task never has more than its shard, or the boundary paths of ``FAN`` shards.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256
from typing import IO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.registry import contract, read
from tabularium.session import shared_path

# Turns in a shard, about.
SHARD_TURNS = 1 << 20
# Shards, or groups of them, whose open nodes meet in a round.
FAN = 64
# Messages in memory before a queue spills.
QUEUE = 1 << 18
# Conversation ids in one chunk of a node's list, and rows sent on at once.
_CHUNK = 1 << 14
_ROWS = 4096

_ROOT = bytes(16)
# Of a node, per range: who it is, what has come together so far, and whether it reaches over the range's ends. Rows with ``ids``
# are chunks of a node's list of members, passed on as they are.
_NODE = (
    "group long, range long, depth int, node binary, parent binary, words long, conv long, n_convs long, n_children long, n_leaves long, saved long, "
    "on_left boolean, on_right boolean, closed boolean, ids string"
)
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 6, *[pa.bool_()] * 3, pa.string()]
_NAMES = [part.split()[0] for part in _NODE.split(", ")]


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _scratch() -> IO[bytes]:
    """A nameless file in the folders that Spark gave this executor for spilling; it goes when the task ends."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


class SpillingQueue:
    """Messages in rising order of their key; beyond ``limit`` the ones in memory move to a sorted run on disk."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.heads, self.runs = limit, [], [], 0

    def push(self, message: tuple) -> None:
        if len(self.heap) >= self.limit:
            run = _scratch()
            for one in sorted(self.heap):
                pickle.dump(one, run)
            run.seek(0)
            self.heap, self.runs = [], self.runs + 1
            self._advance(run, self.runs)
        heapq.heappush(self.heap, message)

    def _advance(self, run: IO[bytes], number: int) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(run), number, run))
        except EOFError:
            run.close()

    def pop(self, key: tuple) -> Iterator[tuple]:
        """All messages with this key; none with a smaller one may be left."""
        while self.heap and self.heap[0][: len(key)] == key:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][: len(key)] == key:
            message, number, run = heapq.heappop(self.heads)
            yield message
            self._advance(run, number)


def _child(node: bytes, turn: bytes) -> bytes:
    return blake2b(node + turn, digest_size=16).digest()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct nodes of a partition's sorted conversations with the members that end there, and those members' ids."""
    shard = TaskContext.get().partitionId()

    def nodes() -> Iterator[tuple]:
        # The path of the last conversation: node, words of its last turn, smallest id and number of members that end there, on the first path.
        path: list[list] = []
        turns: bytes | None = None
        ids: list[int] = []

        def row(depth: int, on_right: bool) -> tuple:
            node, words, conv, n, on_left = path[depth]
            return (shard, shard, depth, node, path[depth - 1][0] if depth else None, words, conv, n, 0, 0, 0, on_left, on_right, False, None)

        def chunk() -> tuple:
            return (shard, shard, None, path[-1][0], None, None, ids[0], *[None] * 7, ",".join(map(str, ids)))

        for conv, key, words in _rows(batches):
            first, shared = turns is None, 0
            if first:
                path.append([_ROOT, 0, None, 0, True])
            else:
                most = min(len(turns), len(key)) // 16
                while shared < most and turns[shared * 16 : shared * 16 + 16] == key[shared * 16 : shared * 16 + 16]:
                    shared += 1
            if ids and (key != turns or len(ids) == _CHUNK):
                yield chunk()
                ids = []
            while len(path) > shared + 1:
                yield row(len(path) - 1, False)
                path.pop()
            for depth in range(shared, len(key) // 16):
                path.append([_child(path[-1][0], key[depth * 16 : depth * 16 + 16]), words[depth], None, 0, first])
            top = path[-1]
            top[2] = conv if top[2] is None else min(top[2], conv)
            top[3] += 1
            ids.append(conv)
            turns = key
        if ids:
            yield chunk()
        for depth in reversed(range(len(path))):
            yield row(depth, True)

    yield from _batches(nodes(), _NAMES, _TYPES)


def _passed_up(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Time-forward processing of rows sorted by group, falling depth and node."""

    def least(a: int | None, b: int | None) -> int | None:
        return b if a is None else a if b is None else min(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple]:
            queue, current = SpillingQueue(limit), None

            def done(state: list) -> tuple:
                """The node with its children's messages; what is complete goes to the parent."""
                group, _, depth, node, parent, words, conv, n, children, leaves, saved, left, right, *_ = state
                for *_, c, more, below, kept in queue.pop((group, -depth, node)):
                    conv, n, children, leaves, saved = least(conv, c), n + more, children + 1, leaves + below, saved + kept
                closed = not left and not right
                if closed:
                    leaves, saved = leaves or 1, saved + (n - 1) * words
                    if parent is not None:
                        queue.push((group, 1 - depth, parent, node, conv, n, leaves, saved))
                return (group, group, depth, node, parent, words, conv, n, children, leaves, saved, left, right, closed, None)

            for row in _rows(batches):
                if row[-1] is not None:
                    yield row
                elif current is not None and (row[0], row[2], row[3]) == (current[0], current[2], current[3]):
                    # The same node from another range of the group.
                    current[6] = least(current[6], row[6])
                    for i in (7, 8, 9, 10):
                        current[i] += row[i]
                    current[11], current[12] = current[11] or row[11], current[12] or row[12]
                else:
                    if current is not None:
                        yield done(current)
                    current = list(row)
            if current is not None:
                yield done(current)

        yield from _batches(nodes(), _NAMES, _TYPES)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, out of chunks sorted by node and first id; one batch is held at a time."""

    def rows() -> Iterator[tuple]:
        node, state = None, None
        for one, _, ids in _rows(batches):
            if one == node:
                state.update(f",{ids}".encode())
            else:
                if state is not None:
                    yield node, state.hexdigest()
                node, state = one, sha256(ids.encode())
        if state is not None:
            yield node, state.hexdigest()

    yield from _batches(rows(), ["node", "ends_sha256"], [pa.binary(), pa.string()])


def _written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, f"trie-{name}")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def gathered(conversations: DataFrame) -> DataFrame:
    """``conv, turns``: per conversation its turns in order, each as the digest of role and text and its number of words.

    ``conversations`` has ``conv_id, turn, role, text``. Null roles and texts are
    empty; a null turn comes first; turns with one number are ordered by their
    digest, and repeated rows are turns of their own. Rows without a conv_id belong to
    no conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("digest"), n_words.alias("words"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), turn.alias("turn"))
    return rows.groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN, queue: int = QUEUE) -> DataFrame:
    """One row per node of the trie of conversations.

    ``conversations`` has ``conv, turns`` as from ``gathered``, one row per
    conversation, ``turns`` possibly empty. Returns ``node, parent, depth, conv,
    parent_conv, n_convs, n_children, n_leaves, saved, ends_sha256``: ``conv`` is the
    smallest member, ``saved`` sums over the subtree the words of each node's last
    turn times its members but one, and the last column is the SHA-256 of the comma-
    joined ids that end at the node. An empty table gives no rows, not even a root.

    One conversation, without its texts, is one value (some 50 bytes a turn), and the
    hash of one node's ids is worked out by one task, as a hash is; it streams
    chunks of ids.
    """
    spark = conversations.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    convs = _written(spark, conversations.select("conv", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "convs")
    n_turns = convs.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-n_turns // shard_turns))
    order = ["group", F.col("depth").desc(), "node"]
    named = convs.repartitionByRange(shards, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_named, _NODE)
    rounds = [_written(spark, named.sortWithinPartitions(*order).mapInArrow(_passed_up(queue), _NODE), "shards")]
    while (last := rounds[-1].agg(F.max("group")).first()[0]) is not None:
        opened = rounds[-1].filter("ids is null and not closed")
        if opened.isEmpty():
            break
        opened = opened.withColumn("group", F.floor(F.col("range") / fan))
        if last < fan:
            # One group holds all that is left: nothing reaches over its ends.
            opened = opened.withColumns({"on_left": F.lit(False), "on_right": F.lit(False)})
        else:
            edges = opened.groupBy("group").agg(F.min("range").alias("leftmost"), F.max("range").alias("rightmost"))
            opened = opened.join(edges, "group").withColumns(
                {"on_left": F.col("on_left") & (F.col("range") == F.col("leftmost")), "on_right": F.col("on_right") & (F.col("range") == F.col("rightmost"))}
            )
        opened = opened.select(*_NAMES).repartition("group").sortWithinPartitions(*order)
        rounds.append(_written(spark, opened.mapInArrow(_passed_up(queue), _NODE), "groups"))
    nodes = rounds[0].filter("closed")
    for one in rounds[1:]:
        nodes = nodes.unionByName(one.filter("closed"))
    chunks = rounds[0].filter("ids is not null").select("node", F.col("conv").alias("first"), "ids")
    ends = chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    whole = nodes.join(ends, "node", "left").join(parents, "parent", "left")
    return whole.select(
        "node", "parent", "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


# What the query shares between conversations: those of one block of ids start like its first one.
_BLOCK_IDS, _HEADS = 20, 4


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv, turns``: conversation c with the first h turns of conversation c - c % 20 in place of its own, h the CRC-32 of c modulo 4."""
    own = gathered(conversations).withColumn("base", F.col("conv") - F.col("conv") % _BLOCK_IDS)
    heads = own.filter(F.col("conv") == F.col("base")).select("base", F.slice("turns", 1, _HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % _HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    tail = F.filter("turns", lambda _, i: i >= h)
    return own.join(heads, "base", "left").select("conv", F.concat(head, tail).alias("turns"))


@contract("op13_prefix_trie")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    trie = prefix_trie(rebuilt(read(spark, folder, "conversations")))
    return trie.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
