"""Both substring operators against counting of all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabularium.llm.repeats import _counted_spans
from tabularium.llm.suffix_runs import remove_repeated_bytes, run_length_matches, suffix_order
from tabularium.llm.suffix_trees import WORDS, deep_leaves, internal_nodes, remove_repeated_words, suffix_tree, with_unique_words
from tabularium.llm.words import word_hashes

from .conftest import AWKWARD, LONG, PASSAGE, frame

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _covered(sequences, length):
    seen = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        yield gone


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, text), gone in zip(texts, _covered([t for _, t in texts], length), strict=True):
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out.append((i, len(text), sum(gone), spans, kept))
    return sorted(out, key=str)


def brute_words(rows, length):
    texts = [(i, _WORD.findall((t or "").encode())) for i, t in rows]
    out = []
    for (i, words), gone in zip(texts, _covered([w for _, w in texts], length), strict=True):
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def repetitive(seed: int, n: int = 60) -> list[tuple[int, str]]:
    draw = random.Random(seed)
    pool = ["".join(draw.choice("ab ") for _ in range(draw.randint(1, 60))) for _ in range(12)]
    return [(i, "".join(draw.choice(pool) for _ in range(draw.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 3), (3, 1)])
def test_bytes(spark, seed, hot):
    rows = repetitive(seed)
    got = remove_repeated_bytes(frame(spark, rows), length=30, gram=6, hot=hot, filter_bits=1 << 12).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=str) == brute_bytes(rows, 30)


@pytest.mark.parametrize(("seed", "hot"), [(4, 4096), (5, 3), (6, 1)])
def test_words(spark, seed, hot):
    rows = repetitive(seed)
    got = remove_repeated_words(frame(spark, rows), length=6, gram=2, hot=hot, filter_bits=1 << 12).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute_words(rows, 6)


def test_one_passage_in_many_places(spark):
    """A hot passage leaves each block as one span per text, however many windows and places it has."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(n, f"own{n} a{n} {passage} b{n} end{n}") for n in range(10_000)] + [(10_000, f"{passage} {passage}")]
    got = {r["doc_id"]: r for r in remove_repeated_words(frame(spark, rows), length=6, gram=2, hot=100, filter_bits=1 << 16).collect()}
    assert all(got[n]["n_removed"] == 30 and got[n]["kept"] == f"own{n} a{n} b{n} end{n}" for n in range(10_000))
    assert got[10_000]["n_removed"] == 60 and len(got) == 10_001
    texts = spark.createDataFrame([(n, t) for n, t in rows], "key long, text string")
    everything = spark.sparkContext.broadcast(np.full(16, -1, np.int64).tobytes())
    spans = _counted_spans(texts, WORDS, 2, 6, everything, 1 << 10)
    assert spans.count() == 10_001
    assert sorted(map(tuple, spans.filter("key >= 9999").collect())) == [(9999, 2, 32), (10_000, 0, 60)]


def test_awkward(spark, awkward, nothing):
    rows = [(i, t) for i, t in AWKWARD if t != LONG]
    got = remove_repeated_bytes(awkward, length=50).collect()
    expected = brute_bytes(rows, 50)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got if r["n_bytes"] != len(LONG)), key=str) == expected
    got = remove_repeated_words(awkward).collect()
    long_row = next(r for r in got if r["doc_id"] == 6)
    words = LONG.split()
    seen = Counter(tuple(words[i : i + 35]) for i in range(60_000 - 34))
    assert long_row["n_words"] == 60_000 and (long_row["n_removed"] > 0) == (max(seen.values()) > 1)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got if r["doc_id"] != 6), key=str) == brute_words(rows, 35)
    assert remove_repeated_bytes(nothing).count() == 0 and remove_repeated_words(nothing).count() == 0


def test_equal_rows_repeat_each_other(spark):
    got = remove_repeated_words(frame(spark, [(1, PASSAGE), (1, PASSAGE), (2, "fine")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 60), (1, 60), (2, 0)]


def test_passage_goes_and_other_texts_stay(spark, awkward):
    kept = with_unique_words(awkward)
    assert kept.columns == awkward.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect() if r["doc_id"]}
    assert texts[7] == "before it after it" and texts[8] == "elsewhere" and texts[4] == "\n\n" and texts[2] is None


def test_small_table(small, spark, rows_of_table):
    import __spark_entry__ as entry

    rows = rows_of_table("select doc_id, text from documents")
    got = sorted(tuple(r) for r in entry.queries()["op1_suffix_runs"](spark, small).collect())
    assert got == sorted((i, n, k, s, hashlib.sha256(kept).hexdigest()) for i, n, k, s, kept in brute_bytes(rows, 200))
    got = sorted(tuple(r) for r in entry.queries()["op7_suffix_trees"](spark, small).collect())
    assert got == sorted((i, n, k, hashlib.sha256(kept.encode()).hexdigest()) for i, n, k, kept in brute_words(rows, 35))


def test_suffix_order():
    draw = np.random.default_rng(0)
    for n in (1, 2, 17, 300):
        symbols = np.append(draw.integers(1, 4, n), 0)
        expected = sorted(range(n + 1), key=lambda i: symbols[i:].tolist())
        assert suffix_order(symbols, 4).tolist() == expected


def test_index_and_tree_agree_with_counting():
    draw = random.Random(7)
    for _ in range(30):
        texts = [bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(1, 6))]
        several = [draw.random() < 0.2 for _ in texts]
        for length in (1, 3, 7):
            seen = Counter()
            for text, twice in zip(texts, several, strict=True):
                for i in range(len(text) - length + 1):
                    seen[text[i : i + length]] += 1 + twice
            expected = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
            assert [x.tolist() for x in run_length_matches(texts, several, length)] == expected
            words = [np.frombuffer(t, np.uint8).astype(np.uint64).tobytes() for t in texts]
            assert [x.tolist() for x in deep_leaves(words, several, length)] == expected


def test_nodes_are_maximal_repeats():
    leaves, depths = suffix_tree([np.array([1, 2, 3, 9], np.uint64), np.array([1, 2, 4], np.uint64), np.array([1, 2, 3], np.uint64)])
    nodes = {(depth, last - first + 1) for depth, first, last in internal_nodes(depths, 1)}
    assert nodes == {(2, 3), (3, 2), (1, 3), (2, 2), (1, 2)}
    assert len(leaves) == 13


def test_word_hashes_of_long_words():
    data = b"x" * (3 << 20) + b" y " + b"z" * 10
    hashes, starts = word_hashes(data)
    assert len(hashes) == 3 and starts.tolist() == [0, (3 << 20) + 1, (3 << 20) + 3]
