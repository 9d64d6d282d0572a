"""Vector codes, language-model scores and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import backoff_lm, prefix_trie, vector_codes

from .conftest import AWKWARD


def codes_of(rows, rounds=4):
    """(id, vector, label) to the query's rows, one distance at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for p in range(4)] for _, v, _ in kept]
    by_id = sorted(range(len(kept)), key=lambda n: (kept[n][0], kept[n][1]))
    books = [[parts[n][p] for n in by_id[:256]] for p in range(4)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for own in parts:
                members[nearest(p, own[p])[1]].append(own[p])
            for e, some in members.items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = [[nearest(p, own[p]) for p in range(4)] for own in parts]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return sorted((i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(kept, found, errors, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, code string, row long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("partition_parts", [1 << 18, 200])
def test_codes(spark, partition_parts):
    draw = random.Random(3)
    hot = [0.25] * 8
    rows = [(n, [float(np.float32(draw.gauss(draw.choice([-1, 0, 2]), 0.3))) for _ in range(8)], draw.choice([None, 0, 1, 2])) for n in range(700)]
    rows += [(1000 + n, hot, 7) for n in range(500)]
    frame = vectors(spark, rows + [(5, None, 1), (6, [None] * 8, 1), (7, [float("nan")] * 8, 1), (8, [float("-inf")] + [0.0] * 7, None)])
    got = vector_codes.compress(frame, partition_parts=partition_parts)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == codes_of(rows)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    few = [(2, [1.0, -2.0, 3.0, 0.5], None), (1, [0.0, 0.0, 0.0, 0.0], None), (1, [0.0, 0.0, 0.0, 0.0], None)]
    assert sorted(map(tuple, vector_codes.compress(vectors(spark, few)).collect())) == codes_of(few)
    odd = [*few, (9, [1.0], 3), (9, [1e9, 0.0, 0.0, 0.0], 3)]
    told = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(vectors(spark, odd)).collect()}
    assert (9, None, None, None) in told and len(told) == 3
    unlike = vector_codes.compress(vectors(spark, [(n, [float(n * k % 7) for k in range(6)], n % 2) for n in range(50)])).collect()
    assert len(unlike) == 50 and all(len(r["code"]) == 8 for r in unlike)
    empty = vector_codes.compress(vectors(spark, [(1, [], 1), (2, [], 1)])).collect()
    assert {r["error"] for r in empty} == {0}


def test_movers_only(spark):
    """The union of residents and movers keeps the owners' partitioning."""
    rdd = spark.sparkContext.parallelize([(i, i) for i in range(40)]).partitionBy(4, vector_codes._owner_partition)
    other = spark.sparkContext.parallelize([(i, -i) for i in range(40)]).partitionBy(4, vector_codes._owner_partition)
    both = rdd.mapPartitions(lambda x: x, preservesPartitioning=True).union(other)
    assert both.getNumPartitions() == 4
    assert all({k % 4 for k, _ in part} == {n} for n, part in enumerate(both.glom().collect()))


def model_scores(rows, held, order, prior):
    """Interpolated probabilities by the formula, longest context first."""
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for _, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for (key, _), words in zip(rows, tokens, strict=True):
        if held(key):
            continue
        text = [None, *words]
        for length in range(1, order + 1):
            for at in range(1 if length == 1 else 0, len(text) - length + 1):
                counts[length][tuple(text[at : at + length])] += 1
    n, v = sum(counts[1].values()), len(counts[1])

    def p(word, context):
        if not context:
            return (counts[1][(word,)] + 0.5) / (n + 0.5 * (v + 1))
        shorter = p(word, context[1:])
        c = counts[len(context)][context]
        return (counts[len(context) + 1][(*context, word)] + prior * shorter) / (c + prior) if c else shorter

    out = []
    for (key, _), words in zip(rows, tokens, strict=True):
        text, total, base = [None, *words], 0.0, 0.0
        for at in range(1, len(text)):
            total += math.log10(p(text[at], tuple(text[max(0, at - order + 1) : at])))
            base += math.log10(p(text[at], ()))
        out.append((key, held(key), len(words), sum(counts[1][(w,)] > 0 for w in words), n, base, total))
    return out


def is_held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def same_scores(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[6], 6))
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-12) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-12)


def held_column():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


@pytest.mark.parametrize(("order", "block_tokens", "shard_grams"), [(2, 1 << 21, 1 << 22), (2, 50, 40), (3, 300, 100), (1, 100, 10), (4, 60, 50)])
def test_model(spark, order, block_tokens, shard_grams):
    draw = random.Random(9)
    words = ["the", "The", "a", "of", "cat", "ÄÖ", "x y", "end", "\x1f", "z" * 300]
    rows = [(n, draw.choice([" ", "\t\n", "  "]).join(draw.choices(words, [40, 5, 20, 10, 5, 3, 2, 2, 2, 1], k=draw.randint(0, 60)))) for n in range(150)]
    rows += [(3, None), (None, "a cat of the end"), (None, None), (4, ""), (7, " \n "), (3, "the the the"), (3, "the the the")]
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, block string, held int")
    got = backoff_lm.score_texts(frame, held_column(), order=order, prior=7.0, block_tokens=block_tokens, shard_grams=shard_grams)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same_scores([tuple(r) for r in got.collect()], model_scores(rows, is_held, order, 7.0))


def test_model_of_odd_tables(spark, awkward, nothing):
    assert backoff_lm.score_texts(nothing, held_column()).count() == 0
    got = [tuple(r) for r in backoff_lm.score_texts(awkward, held_column()).collect()]
    same_scores(got, model_scores(AWKWARD, is_held, 2, 50.0))
    untrained = backoff_lm.score_texts(awkward, F.lit(True)).collect()
    assert {r["score"] for r in untrained} == {0.0} and {r["train_tokens"] for r in untrained} == {0}


def trie_of(rows):
    """conv_id to list of (role, text), as the query's rows."""
    members, children, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for conv, turns in rows.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(conv)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[c] for c in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *totals[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def rebuilt_of(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {conv: [r[3] for r in sorted(t)] for conv, t in by.items()}
    out = {}
    for conv, turns in own.items():
        base = conv - int(math.fmod(conv, 20))
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(base, [])[:h] + turns[h:]
    return out


def trie_columns(frame):
    return frame.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")


TURNS = "conv_id long, turn long, role string, text string, conv string, node long"


@pytest.mark.parametrize(("shard_turns", "fan", "queue"), [(1 << 20, 64, 1 << 18), (20, 2, 3), (7, 3, 1)])
def test_trie(spark, shard_turns, fan, queue):
    draw = random.Random(4)
    rows = []
    for conv in range(160):
        rows += [(conv * (1 if conv % 3 else 7) - 30, n, draw.choice(["user", "assistant", None]), draw.choice(["hi", "a b  c", "", None])) for n in range(draw.randint(1, 5))]
    rows += [(5000 + n, t, "user", f"same {t}") for n in range(120) for t in range(3)]
    rows += [(7000, n, "user", "deep one") for n in range(400)] + [(7020, n, "user", "deep one") for n in range(300)]
    rows += [(8000, None, "user", "first"), (8000, 1, "user", "last"), (8000, 1, "user", "last"), (None, 0, "user", "nobody's")]
    rows = [r for n, r in enumerate(rows) if r not in rows[:n] or draw.random() < 0.5]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    convs = prefix_trie.rebuilt(frame)
    got = trie_columns(prefix_trie.prefix_trie(convs, shard_turns=shard_turns, fan=fan, queue=queue))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(trie_of(rebuilt_of(rows)), key=str)


def test_trie_of_odd_tables(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(nothing)).count() == 0
    # A conversation that loses its only turn, as there is none of the block's first id to start like.
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    lone = spark.createDataFrame([(lost, 0, "user", "gone", "x", 1)], TURNS)
    assert sorted(map(tuple, trie_columns(prefix_trie.prefix_trie(prefix_trie.rebuilt(lone))).collect())) == trie_of({lost: []})


def test_spilling_queue():
    draw = random.Random(1)
    queue = prefix_trie.SpillingQueue(5)
    messages = [(0, n // 10, bytes([draw.randrange(3)]), n) for n in range(100)]
    for message in draw.sample(messages, 100):
        queue.push(message)
    assert queue.runs > 10
    keys = sorted({m[:3] for m in messages})
    assert [sorted(queue.pop(k)) for k in keys] == [sorted(m for m in messages if m[:3] == k) for k in keys]
