"""Language-model scores by a weighted backoff automaton.

The states of the automaton are the empty context and all contexts of up to
``order - 1`` words that the training texts hold. A state has an arc for each word
that followed it there, weighted with the word's smoothed log10 probability, and a
failure arc to its suffix without the first word, weighted with log10 of what the
state leaves to shorter contexts. The empty state has an arc for every word. A text
is read once from left to right: the state is carried along, failure arcs are taken
until the word has an arc, and the weights add up.

Smoothing is Bayesian with the next shorter context as prior (hierarchical
Dirichlet): ``p(w|h) = (c(hw) + prior * p(w|h')) / (c(h) + prior)``, so a failure arc
weighs ``prior / (c(h) + prior)`` whatever the word is, and all words together,
one unseen word counted, have probability 1. The shortest context gives the base:
``(c(w) + 0.5) / (N + 0.5 * (V + 1))``. A text starts in the state of the end token.

The automaton of a corpus grows with it and is never held anywhere as a whole:

1. Documents are cut in blocks of a task's size and written with their words
   numbered, so that later steps meet the same blocks.
2. Each block sends its distinct n-grams, counted over its training texts, to the
   shards of the n-gram space; what a shard gets is spread by hash, and a frequent
   n-gram comes once per block.
3. A shard adds up the counts and answers each block in the order it was asked.
4. A block builds its part of the automaton out of the answers and reads its texts.

Words are told apart by 128 bits of BLAKE2, n-grams of two and more words by 60 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.registry import contract, read
from tabularium.llm.words import mixed
from tabularium.session import shared_path

# Tokens of a block; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 20
# N-grams that a shard adds up at once, about.
SHARD_GRAMS = 1 << 22
# The end token: no word holds a space.
_END = b" "
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Bits of a key by n-gram length; sorted keys are sent as differences, so fewer bits are fewer bytes.
_WORD_BITS, _GRAM_BITS = 64, 60


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8 or 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    whole = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    whole[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return whole.view("<u8").ravel()


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 below 2^32, compressed byte by byte of their value."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(size: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "ids", "held", "ends", "tokens", "words", "more", "n"]
        part, n_blocks = TaskContext.get().partitionId(), 0
        ids, held, numbers, ends, known, n = [], [], [], [], {_END: 0}, 0

        def block() -> pa.RecordBatch:
            digests = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in known), "<u8").reshape(-1, 2)
            # Words are numbered as they come, which gives frequent ones small numbers.
            tokens = squeezed(np.concatenate(numbers))
            row = [(part << 32) + n_blocks, ids, held, np.array(ends, "<i8").tobytes(), tokens, digests[:, 0].tobytes(), digests[:, 1].tobytes(), n]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for one, out, value in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                buffer = value.as_buffer()
                words = buffer.to_pybytes().lower().split() if buffer is not None else []
                words.append(_END)
                ids.append(one)
                held.append(out)
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
                n += len(words)
                ends.append(n)
                if n >= size:
                    yield block()
                    n_blocks += 1
                    ids, held, numbers, ends, known, n = [], [], [], [], {_END: 0}, 0
        if ids:
            yield block()

    return run


class Grams:
    """The n-grams of a block, by length from 1: ``keys`` distinct and sorted, ``at`` the n-gram that ends at each token
    (-1: none, it would reach into the text before), ``first`` a token where each ends."""

    def __init__(self, row: dict, order: int):
        words = np.frombuffer(row["words"], "<u8")
        # Words are numbered anew by the first half of their digest; the few that agree in it keep their order.
        self.order = np.argsort(words, kind="stable")
        place = np.empty(len(words), np.int32)
        place[self.order] = np.arange(len(words))
        self.tokens, self.words = place[unsqueezed(row["tokens"])], words[self.order]
        self.ends = np.frombuffer(row["ends"], "<i8")
        # The end token is the first that a block knows.
        self.end, self.held = int(place[0]), np.array(row["held"], bool)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.in_training = np.repeat(~self.held, self.ends - self.starts)
        # What stands before a text is the end of another one, or of none for the first.
        self.before = np.concatenate(([np.int32(self.end)], self.tokens[:-1]))
        self.keys, self.at, self.first = [self.words], [self.tokens], [np.zeros(0, np.int64)]
        key, valid = self.words[self.tokens], np.ones(len(self.tokens), bool)
        for length in range(2, order + 1):
            shorter = np.concatenate((self.words[[self.end]], key[:-1])) if length == 2 else np.concatenate((key[:1], key[:-1]))
            if length > 2:
                valid = np.concatenate(([False], valid[:-1])) & (self.before != self.end)
            key = mixed((shorter + np.uint64(length)) * _STEP ^ self.words[self.tokens])
            places = np.flatnonzero(valid)
            keys, first, inverse = np.unique(key[places] >> np.uint64(64 - _GRAM_BITS), return_index=True, return_inverse=True)
            at = np.full(len(key), -1, np.int32)
            at[places] = inverse
            self.keys.append(keys)
            self.at.append(at)
            self.first.append(places[first])

    def counts(self, length: int) -> np.ndarray:
        """How often each n-gram of a length ends at a token of a training text."""
        at = self.at[length - 1][self.in_training]
        return np.bincount(at[at >= 0], minlength=len(self.keys[length - 1]))


def _asked(order: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The counted n-grams of each block, cut by shard: the first bits of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                grams = Grams(row, order)
                rest = np.frombuffer(row["more"], "<u8")[grams.order]
                for length in range(1, order + 1):
                    keys, counts = grams.keys[length - 1], grams.counts(length)
                    shards = (keys >> np.uint64((_WORD_BITS if length == 1 else _GRAM_BITS) - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    edges = np.concatenate((np.flatnonzero(np.diff(shards, prepend=-1)), [len(keys)]))
                    out = []
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        more = rest[a:b].tobytes() if length == 1 else b""
                        out.append((int(shards[a]), row["block"], length, packed(np.diff(keys[a:b], prepend=np.uint64(0))), more, zlib.compress(packed(counts[a:b]), 1)))
                    if out:
                        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["shard", "block", "length", "keys", "more", "counts"])

    return run


def _answers(group: pa.Table) -> pa.Table:
    """To each asking block the counts in all training texts less its own, and per shard and length a row without a block: distinct n-grams seen there, and their count."""
    rows, out = group.to_pylist(), []
    for length in sorted({r["length"] for r in rows}):
        own = [r for r in rows if r["length"] == length]
        keys = np.concatenate([np.cumsum(unpacked(r["keys"]), dtype=np.uint64) for r in own])
        each = [unpacked(zlib.decompress(r["counts"])) for r in own]
        counts = np.concatenate(each)
        more = np.concatenate([np.frombuffer(r["more"], "<u8") for r in own]) if length == 1 else None
        order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
        fresh = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))
        if more is not None:
            fresh[1:] |= more[order[1:]] != more[order[:-1]]
        sums = np.add.reduceat(counts[order], np.flatnonzero(fresh))
        total = np.empty(len(keys), np.uint64)
        total[order] = sums[np.cumsum(fresh) - 1]
        others, at = total - counts, 0
        for r, n in zip(own, map(len, each), strict=True):
            out.append((r["block"], length, r["shard"], zlib.compress(packed(others[at : at + n]), 1), None, None))
            at += n
        out.append((None, length, own[0]["shard"], None, int((sums > 0).sum()), int(sums.sum())))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["block", "length", "shard", "others", "n_distinct", "n_total"])


class Automaton:
    """The part of the automaton that the texts of a block can reach.

    ``arcs[k]`` is the weight of the arc out of the state of length k before a
    token, nan where there is none; ``failures[k]`` the weight of that state's
    failure arc. ``known`` says which tokens the training texts hold.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], n_total: int, n_distinct: int, prior: float):
        single = (counts[0] + 0.5) / (n_total + 0.5 * (n_distinct + 1))
        self.base = np.log10(single)[grams.tokens]
        self.known = counts[0][grams.tokens] > 0
        self.arcs, self.failures = [self.base], [np.zeros(len(grams.tokens))]
        shorter_p = single
        for length in range(2, len(counts) + 1):
            first, seen = grams.first[length - 1], counts[length - 1] > 0
            context = grams.before if length == 2 else np.concatenate(([-1], grams.at[length - 2][:-1]))
            c_context = np.append(counts[length - 2], 0)[context]
            with np.errstate(divide="ignore"):
                p = (counts[length - 1] + prior * shorter_p[grams.at[length - 2][first]]) / (c_context[first] + prior)
                arc = np.where(seen, np.log10(p), np.nan)
                failure = np.log10(prior / (c_context + prior))
            there = grams.at[length - 1] >= 0
            self.arcs.append(np.where(there, arc[grams.at[length - 1]], np.nan) if len(arc) else np.full(len(there), np.nan))
            self.failures.append(np.where(there & (c_context > 0), failure, 0.0))
            shorter_p = p
        self.start = 1 if len(counts) > 1 and counts[0][grams.end] > 0 else 0

    def read(self, start: int, stop: int) -> float:
        """The log10 probability of the tokens of one text, read from left to right."""
        longest, total, state = len(self.arcs) - 1, 0.0, self.start
        arcs = [a[start:stop].tolist() for a in self.arcs]
        failures = [f[start:stop].tolist() for f in self.failures]
        for i, known in enumerate(self.known[start:stop].tolist()):
            while state and arcs[state][i] != arcs[state][i]:
                total += failures[state][i]
                state -= 1
            total += arcs[state][i]
            # The longest suffix of what was read that is a state.
            state = (state + 1 if state < longest else longest) if known else 0
        return total


def _scorer(order: int, prior: float, n_total: int, n_distinct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        told = sorted(answers.to_pylist(), key=lambda r: (r["length"], r["shard"]))
        row = blocks.to_pylist()[0]
        grams = Grams(row, order)
        counts = []
        for length in range(1, order + 1):
            others = [unpacked(zlib.decompress(r["others"])) for r in told if r["length"] == length]
            own = grams.counts(length)
            counts.append(own + np.concatenate(others).astype(np.int64) if others else own)
        automaton = Automaton(grams, counts, n_total, n_distinct, prior)
        sums = np.concatenate(([0], np.cumsum(automaton.known)))
        base = np.add.reduceat(automaton.base, grams.starts)
        scores = [automaton.read(a, b) for a, b in zip(grams.starts.tolist(), grams.ends.tolist(), strict=True)]
        n = len(scores)
        return pa.table({
            "id": blocks.column("ids").chunk(0).flatten(),
            "held_out": pa.array(grams.held), "n_tokens": pa.array(grams.ends - grams.starts, pa.int64()),
            "n_known": pa.array(sums[grams.ends] - sums[grams.starts], pa.int64()), "train_tokens": pa.array([n_total] * n, pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64()),
        })

    return score


def score_texts(
    documents: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text",
    order: int = 2, prior: float = 50.0, block_tokens: int = BLOCK_TOKENS, shard_grams: int = SHARD_GRAMS,
) -> DataFrame:
    """Log10 probabilities of all texts under a model of those that are not held out.

    Returns ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one
    row per row of ``documents``, so repeated rows come as often as they are there
    and count as often. Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after A-Z became
    a-z, and one end. A null text is empty: an end alone. A row for which
    ``held_out`` is null is not held out; a null id stays null. An empty table gives
    no rows; without training texts every probability is 1. Other columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    texts = documents.select(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_column).alias("text"))
    id_sql = texts.schema["id"].dataType.simpleString()
    id_type = texts.limit(0).select("id").toArrow().schema.field("id").type
    path = shared_path(spark, "lm-blocks")
    schema = f"block long, ids array<{id_sql}>, held array<boolean>, ends binary, tokens binary, words binary, more binary, n long"
    texts.mapInArrow(_blocks(block_tokens, id_type), schema).write.parquet(path)
    blocks = spark.read.parquet(path)
    n_tokens = blocks.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (n_tokens * order // shard_grams).bit_length())
    asked = blocks.select("block", "held", "ends", "tokens", "words", "more").mapInArrow(
        _asked(order, bits), "shard int, block long, length int, keys binary, more binary, counts binary"
    )
    path = shared_path(spark, "lm-counts")
    answers = asked.groupBy("shard").applyInArrow(_answers, "block long, length int, shard int, others binary, n_distinct long, n_total long")
    answers.write.parquet(path)
    answers = spark.read.parquet(path)
    sums = answers.filter(F.col("block").isNull() & (F.col("length") == 1)).agg(F.sum("n_total").alias("n"), F.sum("n_distinct").alias("v")).first()
    replies = answers.filter(F.col("block").isNotNull()).select("block", "length", "shard", "others")
    scorer = _scorer(order, prior, sums["n"] or 0, sums["v"] or 0)
    out = f"id {id_sql}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = blocks.drop("n", "more").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scorer, out)
    return scored.withColumnRenamed("id", id_column)


@contract("op12_backoff_lm")
def op12_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score_texts(read(spark, folder, "documents"), held_out)
