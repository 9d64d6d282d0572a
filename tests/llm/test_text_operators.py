"""Near duplicates, contamination, licences, toxicity, fingerprints."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import bagminhash, licenses, multiset_hash, simhash, toxicity
from tabularium.llm.registry import read

from .conftest import AWKWARD, frame

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return _WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def shingles(text):
    words = plain(text)
    if not words:
        return Counter([("none", text or "")])
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def classes(rows):
    bags = [shingles(t) for _, t in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, bag in enumerate(bags):
        for j in {j for s in bag for j in holders[s]}:
            if jaccard(bag, bags[j]) >= 0.8:
                parent[root(i)] = root(j)
        for s in bag:
            holders[s].append(i)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    return sorted(((min((k for k in g if k is not None), default=None), len(g), k) for g in groups.values() for k in g), key=str)


def near(frame_):
    return sorted(((r["class_id"], r["class_size"], r["doc_id"]) for r in bagminhash.near_duplicates(frame_).collect()), key=str)


def test_near_duplicates_of_the_table(spark, small, rows_of_table):
    assert near(read(spark, small, "documents")) == classes(rows_of_table("select doc_id, text from documents"))


def test_near_duplicates_awkward(awkward, nothing):
    assert near(awkward) == classes(AWKWARD)
    assert near(nothing) == []


def test_near_duplicates_in_a_chain(spark):
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(12):
        words = base.copy()
        for j in range(i):
            words[j * 20] = f"other{j}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"far{i}x{j}" for j in range(50))) for i in range(5)]
    assert near(frame(spark, rows)) == classes(rows)


def test_near_duplicates_in_a_family_close_to_the_threshold(spark, monkeypatch):
    draw = random.Random(7)
    base, rows = [f"word{i}" for i in range(200)], []
    for i in range(100):
        words = base.copy()
        for j in draw.sample(range(200), draw.randint(3, 7)):
            words[j] = f"own{i}x{j}" if draw.random() < 0.5 else f"other{j}"
        rows.append((i, " ".join(words[: 200 - draw.randint(0, 33)])))
    across, pairs = bagminhash._across_classes, []

    def counted(*given):
        found = across(*given)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(bagminhash, "_across_classes", counted)
    assert near(frame(spark, rows)) == classes(rows)
    # All pairs are 4 950; before texts were compared by what tells them apart from their home, 1 476 were verified.
    assert len(pairs) == 1 and pairs[0] < 4 * len(rows)


def test_one_of_each(awkward):
    kept = bagminhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({(a, b) for a, b, _ in classes(AWKWARD) if b > 1}) + sum(b == 1 for _, b, _ in classes(AWKWARD))


def test_signatures_are_unbiased():
    a, b = Counter({i: 1 + i % 4 for i in range(120)}), Counter({i: 1 + i % 3 for i in range(40, 160)})
    exact = jaccard(a, b)
    found = []
    for seed in range(60):
        owner = np.repeat([0, 1], [len(a), len(b)])
        hashed = bagminhash.mixed(np.array([*a, *b], np.uint64) + np.uint64(seed * 1000))
        weight = np.array([*a.values(), *b.values()])
        signature = bagminhash.signatures(owner, hashed, weight, 2, 128)
        found.append((signature[0] == signature[1]).mean())
    assert abs(np.mean(found) - exact) < 0.02


def leaks(rows, items):
    out = {}
    for key, text in rows:
        words = plain(text)
        for item, wanted in items:
            asked = plain(wanted)
            n = len(asked)
            best = None
            for i in range(len(words) - n + 1 if n else 0):
                size = min(5, n)
                a = Counter(tuple(words[i + j : i + j + size]) for j in range(n - size + 1))
                b = Counter(tuple(asked[j : j + size]) for j in range(n - size + 1))
                similarity = jaccard(a, b)
                if similarity >= 0.8 and (best is None or similarity > best[1] + 1e-12):
                    best = (i, similarity)
            if best:
                out[key, item] = (best[0], n, round(best[1], 9))
    return out


def test_contamination(spark):
    item = " ".join(f"q{i}" for i in range(30))
    edited = item.replace("q28", "changed")
    rows = [
        (1, f"start {item} end"), (2, f"{edited} tail"), (3, f"a b {item.upper()}!"), (4, " ".join(f"q{i}" for i in range(0, 30, 2))),
        (5, f"{item} {item}"), (6, "two words"), (7, "only two, words here"), (8, None), (9, ""), (1, f"start {item} end"), (None, item),
    ]
    items = [(1, item), (2, "two words"), (3, None), (4, ""), (5, item)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = simhash.contaminated(frame(spark, rows), benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 9)) for r in found}
    assert got == leaks(rows, items) and len(found) == len(got)
    assert simhash.contaminated(frame(spark, []), benchmark).count() == 0
    assert simhash.contaminated(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_contamination_of_the_table(spark, small, rows_of_table):
    found = simhash.contaminated(read(spark, small, "documents"), read(spark, small, "benchmark")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 9)) for r in found}
    items = rows_of_table("select item_id, text from benchmark")
    grams = {g for _, t in items for g in shingles(t)}
    rows = [(k, t) for k, t in rows_of_table("select doc_id, text from documents") if grams & set(shingles(t))]
    assert got == leaks(rows, items)


def short_leaks(rows, items):
    """Documents shorter than an item, compared as a whole."""
    out = {}
    for key, text in rows:
        for item, wanted in items:
            words, n = plain(text), len(plain(wanted))
            size = min(5, n)
            a, b = (Counter(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) for w in (words, plain(wanted)))
            if len(words) < n and a and jaccard(a, b) >= 0.8:
                out[key, item] = (0, len(words), round(jaccard(a, b), 9))
    return out


def test_contamination_of_documents_shorter_than_the_item(spark):
    words = [f"q{i}" for i in range(59)]
    items = [(1, " ".join(words)), (2, " ".join(words[:50])), (3, "one two three four five six seven"), (4, "a b c d"), (5, " ".join(["ring"] * 30))]
    cuts = [words[:-n] for n in range(1, 16)] + [words[n:] for n in range(1, 16)] + [words[n:-n] for n in range(1, 8)]
    edited = [[w if i != 20 else "other" for i, w in enumerate(cut)] for cut in cuts]
    texts = [" ".join(cut) for cut in cuts + edited] + ["one two three four five six", "two three four five six seven", "a b c", "q1 q2 q3", " ".join(["ring"] * 27), ""]
    rows = list(enumerate(texts))
    found = simhash.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 9)) for r in found}
    assert got == leaks(rows, items) | short_leaks(rows, items) and len(found) == len(got)
    assert got[0, 1] == (0, 58, round(54 / 55, 9)) and len(short_leaks(rows, items)) > 40


def test_blocks_guarantee_the_radius():
    draw = np.random.default_rng(3)
    for _ in range(200):
        a = int(draw.integers(0, 1 << 63))
        b = a
        for bit in draw.choice(64, simhash.RADIUS, replace=False):
            b ^= 1 << int(bit)
        values = np.array([a, b], np.uint64).view(np.int64)
        exact = simhash.block_keys(values[:1], np.array([9]), 0)[0]
        around = simhash.block_keys(values[1:], np.array([9]), simhash.RADIUS // simhash.BLOCKS)[0]
        assert set(exact) & set(around)


def test_licenses(spark, nothing):
    rows = [
        (1, "Released under the MIT License. Under The MIT license!"), (2, None), (3, ""), (4, "cc-by-nc and Apache License, Version 2.0"),
        (5, "under the mit"), (6, "Permission is hereby granted, free of charge, to ANY person obtaining one copy of this software and associated documentation"),
        (1, "Released under the MIT License. Under The MIT license!"),
    ]
    found = licenses.scan(frame(spark, rows), licenses.template_table(spark)).collect()
    labels = sorted((r["doc_id"], r["n_words"], sorted((s["label"], s["is_base"], s["first"]) for s in r["spans"])) for r in found)
    assert labels == [
        (1, 9, [("mit", True, 1), ("mit", True, 5)]), (1, 9, [("mit", True, 1), ("mit", True, 5)]), (2, 0, []), (3, 0, []),
        (4, 9, [("apache-2", True, 4), ("cc-by-nc", True, 0)]), (5, 3, []), (6, 19, [("mit", False, 0)]),
    ]
    assert licenses.scan(nothing, licenses.template_table(spark)).count() == 0


@pytest.fixture(scope="module")
def prints(spark):
    def of(*texts):
        frame_ = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, text string")
        return multiset_hash.fingerprints(frame_, "key")

    return of


def test_fingerprints_ignore_order_and_follow_edits(prints):
    rows = prints("one two\nthree", "three\none two", "one two", "three", None, "", "one two\nthree\nthree").alias("a")
    by_key = {r["key"]: r["fingerprint"] for r in rows.collect()}
    assert by_key[0] == by_key[1] != by_key[6] and by_key[4] == by_key[5]
    a, b, part = (rows.filter(F.col("key") == i).select(F.col("fingerprint").alias(n)) for i, n in ((2, "a"), (3, "b"), (0, "whole")))
    told = a.crossJoin(b).crossJoin(part).select(
        multiset_hash.inserted(F.col("a"), F.col("b")).alias("sum"), multiset_hash.deleted(F.col("whole"), F.col("b")).alias("rest"), "a", "whole"
    ).first()
    assert told["sum"] == told["whole"] and told["rest"] == told["a"]


def test_the_wide_part_is_the_whole_digest(prints):
    rows = {r["key"]: r["fingerprint"]["dense"] for r in prints("one two", "日本 🙂", "", "one two\n日本 🙂").collect()}
    for key, text in enumerate(("one two", "日本 🙂", "")):
        digest = hashlib.sha256(text.encode()).digest()
        assert sorted(rows[key]) == sorted(int.from_bytes(digest[i : i + 4]) for i in range(0, 32, 4))
    assert rows[3] == [(a + b) % (1 << 32) for a, b in zip(rows[0], rows[1], strict=True)]


def test_edit_report(spark, nothing):
    rows = [(3, "gamma delta " * 20), (1, "alpha beta\n" * 9), (7, None), (1, "alpha beta\n" * 9), (None, "no id"), (9, "日本 🙂🙂🙂"), (1, "other")]
    found = multiset_hash.edit_report(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = {(r["doc_id"], r["n_chars"]): r for r in found}
    # 9 is the last; null comes first.
    text, after = "日本 🙂🙂🙂", "no id"
    assert texts[9, 6]["edited_sha256"] == hashlib.sha256((text[:5] + after[:1]).encode()).hexdigest()
    text, after = "gamma delta " * 20, ""
    assert texts[3, 240]["edited_sha256"] == hashlib.sha256((text[:180] + after).encode()).hexdigest()
    assert texts[7, 0]["near_edited"] == 1.0
    assert texts[1, 99]["fingerprint"] == next(r["fingerprint"] for r in found if r["n_chars"] == 99)
    assert multiset_hash.edit_report(nothing).count() == 0
    alone = multiset_hash.edit_report(frame(spark, [(1, "abcdefgh")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def toxic_corpus():
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([f"neutral{i * j % 50}" for j in range(1, 30)] + ([f"nasty{'abc'[i % 3]}", "vile"] if bad else []))))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, awkward, nothing):
    rows, labels = toxic_corpus()
    documents = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (3, 7)], "doc_id long, toxic int")
    index = toxicity.fitted(spark, documents, marks)
    assert {t for t in index.places if t in (b" vile", b"vile", b"nast")}
    scored = toxicity.score_toxicity(documents, index).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored)
    assert all(len(r["evidence"]) == 3 and all(e["toxic"] for e in r["evidence"]) for r in scored if r["doc_id"] % 4 == 0)
    # A word that was never seen, of a stem that was.
    odd = toxicity.score_toxicity(frame(spark, [(1, "so nastyzzz, so Vile"), (2, None), (3, "")]), index).collect()
    assert [r["score"] >= 0.5 for r in sorted(odd, key=lambda r: r["doc_id"])] == [True, False, False]
    assert toxicity.score_toxicity(awkward, index).count() == len(AWKWARD) and toxicity.score_toxicity(nothing, index).count() == 0
    kept = toxicity.without_toxic(documents, index)
    assert kept.columns == documents.columns and kept.count() == 300
    blank = toxicity.fitted(spark, documents, marks.limit(0))
    assert toxicity.score_toxicity(documents, blank).filter("score >= 0.5 and score is not null").count() in (0, 400)


def test_blocks_give_the_result_of_a_full_scan(spark):
    rows, labels = toxic_corpus()
    index = toxicity.fitted(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    draw = np.random.default_rng(1)
    full = np.zeros((len(index.ids), len(index.places)))
    for term in range(len(index.places)):
        own = slice(index.starts[term], index.starts[term + 1])
        full[index.postings[own], term] = index.weights[own]
    for _ in range(50):
        counts = {int(t): int(draw.integers(1, 4)) for t in draw.choice(len(index.places), min(3, len(index.places)), replace=False)}
        at, weights = index.weigh(counts)
        cosines = np.round(full[:, at] @ weights, 12)
        best = np.lexsort((np.arange(len(cosines)), -cosines))[:15]
        best = best[cosines[best] > 0]
        found, values = index.neighbours(at, weights, 15)
        assert np.allclose(values, cosines[best]) and found.tolist() == best.tolist()


def test_blocks_that_cannot_reach_are_not_read(spark, monkeypatch):
    """Examples of several kinds, more than a few blocks: the same as a full scan, from fewer blocks."""
    draw = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1200):
        kind = i % 6
        words = [f"k{kind}w{j}" for j in draw.integers(0, 120, 40)] + [f"all{j}" for j in draw.integers(0, 30, 10)]
        rows.append((i, " ".join(words + (["vile", "nasty"] if i % 7 == 0 else []))))
        labels.append((i, int(i % 7 == 0)))
    monkeypatch.setattr(toxicity, "COMMON", 300)
    index = toxicity.fitted(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    full = np.zeros((len(index.ids), len(index.places)))
    for term in range(len(index.places)):
        full[index.postings[index.starts[term] : index.starts[term + 1]], term] = index.weights[index.starts[term] : index.starts[term + 1]]
    asked = []
    once = toxicity.Blocks._read
    monkeypatch.setattr(toxicity.Blocks, "_read", lambda self, wanted, *rest: (asked.append(wanted.mean()), once(self, wanted, *rest))[1])
    vectors = [index.weigh(*index.counts(text.encode())) for _, text in rows[:50]] + [index.weigh({}), index.weigh(*index.counts(b"vile"))]
    alone = tuple([*range(50), -1, -1])
    for but in ((), alone):
        for i, ((at, weights), (found, values)) in enumerate(zip(vectors, index.nearest(vectors, 15, but), strict=True)):
            cosines = np.round(full[:, at] @ weights, 12)
            if but and i < 50:
                cosines[i] = 0
            best = np.lexsort((np.arange(len(cosines)), -cosines))[:15]
            best = best[cosines[best] > 0]
            assert np.allclose(values, cosines[best], atol=1e-11) and found.tolist() == best.tolist()
    assert sum(asked[:2]) < 0.6


def test_clean_texts_with_the_beginning_of_a_toxic_word(spark):
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"neutral{j}" for j in draw.integers(0, 200, 15)] + ["the", "river", "leads", "to", "a", "garden"][: int(draw.integers(0, 7))]
        rows.append((i, " ".join(words + (["pathetic", "worthless"][i % 8 // 4 :] if bad else []))))
        labels.append((i, int(bad)))
    index = toxicity.fitted(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b" river" in index.places and b"path" not in index.places and b"wort" not in index.places
    long = " ".join(f"neutral{j % 200} unseen{j}" for j in range(20_000))
    texts = ["the garden path leads to the river", "a book worth reading", "path", f"{long} path", f"{long} worth {long}", long, f"{rows[3][1]} path"]
    clean = toxicity.score_toxicity(frame(spark, list(enumerate(texts))), index).collect()
    assert len(clean) == len(texts) and all(r["score"] < 0.5 for r in clean)
    toxic = toxicity.score_toxicity(frame(spark, [(1, "how pathetic"), (2, f"{rows[3][1]} worthless, pathetic")]), index).collect()
    assert all(r["score"] >= 0.5 for r in toxic)
    # The norm is over the whole text, also over words that no example has.
    alone, beside = (index.neighbours(*index.weigh(*index.counts(text)), 1)[1][0] for text in (b"pathetic", b"pathetic unseen words"))
    assert beside < 0.95 * alone


def test_toxic_filter_sends_each_text_once_and_hands_on_parts(spark, monkeypatch):
    texts = [f"word{i % 7} plain{i}" + (" vile nasty" if i % 3 == 0 else "") for i in range(60)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, Text string").coalesce(1)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    index = toxicity.fitted(spark, documents.withColumnRenamed("Text", "text"), marks)
    # A posting's place and weight lie side by side.
    assert index.held.dtype.itemsize == 8 and len(index.held) == index.starts[-1]
    kept = toxicity.without_toxic(documents, index)
    sent = kept._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1]
    assert "struct(doc_id" in sent and " AS text" not in sent
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents, index).collect()}
    monkeypatch.setattr(toxicity, "HANDED_ON", 7)
    assert kept.columns == ["doc_id", "Text"]
    assert {(r["doc_id"], r["Text"]) for r in toxicity.without_toxic(documents, index).collect()} == {(i, t) for i, t in enumerate(texts) if scores[i] < 0.5}
