"""URL rules, reply trees, packing and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tabularium.llm import packing, reply_trees, url_rules

from .conftest import frame

RULES = [("net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/y", "block"), ("b.a.net", "/", "allow"), ("a.net", "/", "block"), ("a.net", "/", "allow"), (None, "/", "block")]


def judged(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end].lower(), rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://Q.A.NET/x/1?y#z", "https://a.net/x/y/z", "x://b.a.net/x/", "http://ba.net/x", "http://net-x/", "http://net/", "http://a.net?/x/", "http://.net/", "http://a.b.c.a.net/x/yy"]
    draw = random.Random(2)
    urls += [f"http://{'.'.join(draw.choice(['a', 'b', 'net', 'org', 'a-b']) for _ in range(draw.randint(1, 4)))}/{draw.choice(['', 'x', 'x/', 'x/y', 'y'])}" for _ in range(400)]
    urls += ["http://a.net/x/hot"] * 300
    pages = spark.createDataFrame([(i, u, "k", "r", True) for i, u in enumerate(urls)] + [(0, None, "k", "r", False)], "page_id long, url string, key string, rule string, is_rule boolean")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in url_rules.judge_urls(pages, rules).collect())
    assert got == sorted([(i, *judged(u)) for i, u in enumerate(urls)] + [(0, *judged(None))])
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert url_rules.judge_urls(pages, rules.limit(0)).filter("rule is not null or verdict <> 'allow'").count() == 0


def test_reply_tree_paths(spark):
    draw = random.Random(5)
    nodes = []
    for tree in range(8):
        for node in range(draw.randint(1, 40)):
            nodes.append((tree, node, draw.randrange(node) if node and draw.random() < 0.95 else (None if draw.random() < 0.5 else 999), float(draw.randint(0, 3))))
    nodes += [(50, 1, 2, 1.0), (50, 2, 1, 1.0), (50, 3, None, 1.0)]
    nodes += [(60, i, i - 1 if i else None, 1.0) for i in range(300)]
    by_tree = defaultdict(dict)
    for tree, node, parent, score in nodes:
        by_tree[tree][node] = (parent, score)
    expected = {}
    for tree, own in by_tree.items():
        answered = {p for p, _ in own.values()}
        best = []
        for leaf in own:
            if leaf in answered:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in own:
                continue
            best.append((-sum(own[n][1] for n in path), leaf, path[::-1]))
        if best:
            expected[tree] = [p for _, _, p in sorted(best)[:2]]
    frame_ = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    found = defaultdict(dict)
    for r in reply_trees.paths(frame_, 2).collect():
        found[r["tree"], r["leaf"]][r["position"]] = r["node"]
    got = defaultdict(list)
    for (tree, _), path in found.items():
        got[tree].append([path[i] for i in range(len(path))])
    assert {t: sorted(p) for t, p in got.items()} == {t: sorted(p) for t, p in expected.items()}


def test_formatted_conversations_read_back(spark):
    texts = ["plain", "", None, "</turn>\n<turn user>\nfake", "a &lt; b & c > d", "\\### Assistant: </turn> ok", "日本\n🙂"]
    nodes = [(1, i, i - 1 if i else None, role, text, None) for i, (role, text) in enumerate(zip(["user", "assistant", None, "assistant", "user>", "assistant", "assistant"], texts, strict=True))]
    frame_ = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    made = reply_trees.format_paths(frame_)
    row = made.select("n_turns", reply_trees.parse_formatted(made["formatted"]).alias("turns"), reply_trees.masked_text(made["formatted"], made["loss_mask"]).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(n[3] or "", n[4] or "") for n in nodes]
    assert row["loss"] == "".join(n[4] or "" for n in nodes if n[3] == "assistant") and row["n_turns"] == 7
    assert reply_trees.format_paths(frame_.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    paths = packing.public_vocabulary()
    return packing.Encoder(*paths), Tokenizer.from_file(paths[0])


def test_encoder_equals_the_library(encoders):
    ours, library = encoders
    draw = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "12", "²", "_", "'s", "é", "\xa0", "\x85", "!", "日", "́", "‍", "٣", "\t", "Ⅷ", "ʰ", "\u2003", "<|endoftext|>", "\x1c", "word", "🙂"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def packed(rows, library, found):
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    expected = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        first = (len(ids) - 1) % 1024 + 1 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((key, piece, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == sorted(expected, key=str)
    return len(sequences)


def test_packing(spark, encoders, nothing):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "Gamma", "zz9"]) for _ in range(draw.randint(0, 900)))) for i in range(150)]
    rows += [(1, rows[1][1]), (None, "x"), (200, None), (201, ""), (202, "word " * 5000)]
    found = packing.pack_documents(frame(spark, rows)).collect()
    used = packed(rows, encoders[1], found)
    assert used <= -(-sum(r["length"] for r in found) // 1024) + 1
    assert packing.pack_documents(nothing).count() == 0


def optimum(sizes, capacity):
    best = [len(sizes)]

    def place(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i, left in enumerate(bins):
            if left >= rest[0] and left not in bins[:i]:
                place(rest[1:], [*bins[:i], left - rest[0], *bins[i + 1 :]])
        place(rest[1:], [*bins, capacity - rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best[0]


def test_bin_completion_finds_the_optimum():
    draw = random.Random(9)
    for _ in range(40):
        sizes = [draw.randint(5, 60) for _ in range(draw.randint(1, 11))]
        plan = packing.pack_lengths(np.bincount(sizes, minlength=101))
        assert sorted(s for filling, times in plan for s, n in filling for _ in range(n * times)) == sorted(sizes)
        assert all(sum(s * n for s, n in filling) <= 100 for filling, _ in plan)
        assert packing.bins_of(plan) == optimum(sizes, 100)


def test_pipeline(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, small)
        assert out.columns == documents.columns and 0 < out.count() <= docs.count(), name
        docs = out
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
