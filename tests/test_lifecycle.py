from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tabularium.functions import arrays
from tabularium.operators.activity import sessions
from tabularium.operators.dense import hashing_embedder
from tabularium.operators.images import data_uri, extract_images, image_text, resolve_markers
from tabularium.operators.lifecycle import (
    MANIFEST,
    detect_changes,
    erase_sources,
    files_in_collection,
    ingest_stats,
    reconcile,
    reconcile_reply,
    record_outcomes,
    retain,
    retention_reply,
)
from tabularium.operators.ranking import latest, top_k
from tabularium.operators.routing import route
from tabularium.operators.upsert import keyed_merge, keyed_upsert, upsert_counts
from tabularium.session import shared_path, shared_root
from tabularium.sources.collection import build_points, checked, collection
from tabularium.sources.files import list_names
from tabularium.sources.keyed import KeyedTable
from tabularium.streaming.ingest import MOVED, TORN, IngestTarget, ingest_batch, ingest_files, manifest_table, remove_missing



def now():
    return F.expr("timestamp'2024-02-01 00:00:00'")


@pytest.fixture
def points(spark):
    rows = [
        ("1", "p/a", "h1", "10", "pdf"), ("2", "p/a", "h1", "11", "pdf"), ("3", "p/b", "h2", "9", "txt"),
        ("4", None, "h3", "1", "x"), ("5", "", "h4", "1", "x"), ("6", "p/c", None, "1", "x"), ("7", "p/a", "h0", "5", "old"),
    ]
    return spark.createDataFrame(rows, "id string, source string, fileHash string, fileSize string, contentType string")


def manifest(spark, rows):
    return spark.createDataFrame(rows, MANIFEST)


def test_reconcile(spark, points):
    old = manifest(spark, [("p/a", "hx", None, 9, "1", "t", "failed"), ("p/z", "hz", None, 1, "1", "t", None)])
    rebuilt = reconcile(old, points, now())
    rows = {r["file_path"]: r for r in rebuilt.collect()}
    assert set(rows) == {"p/a", "p/b", "p/z"}
    assert (rows["p/a"]["file_hash"], rows["p/a"]["chunk_count"], rows["p/a"]["file_size"], rows["p/a"]["last_error"]) == ("h1", 2, "10", None)
    assert rows["p/z"]["file_hash"] == "hz"
    assert sorted(reconcile(rebuilt, points, now()).collect()) == sorted(rebuilt.collect())
    assert tuple(reconcile_reply(points).first()) == (5, 3)
    assert files_in_collection(points).count() == 5


def test_statistics(spark):
    assert tuple(ingest_stats(manifest(spark, [])).first()) == (0, 0, None, None)
    moment = datetime.datetime(2024, 1, 1)
    rows = [("a", "h", moment, 1, None, None, None), ("b", "h", None, 2, None, None, None), ("c", "h", None, 2, None, None, None)]
    assert tuple(ingest_stats(manifest(spark, rows)).first()) == (3, 5, moment, 1.67)


def test_changes(spark):
    old = manifest(spark, [("same", "1", None, 1, None, None, None), ("mod", "1", None, 1, None, None, None), ("gone", "1", None, 1, None, None, None), ("bad", "1", None, 1, None, None, "e")])
    listing = spark.createDataFrame([("same", "1"), ("mod", "2"), ("new", "3"), ("bad", "1")], "file_path string, file_hash string")
    found = {r["file_path"]: r["status"] for r in detect_changes(listing, old).collect()}
    assert found == {"same": "unchanged", "mod": "modified", "gone": "deleted", "new": "new", "bad": "failed"}


def test_outcomes(spark):
    old = manifest(spark, [("a", "h1", None, 3, "1", "t", None), ("b", "h1", None, 3, "1", "t", "broken")])
    done = manifest(spark, [("a", "h2", None, 9, "1", "t", "no text"), ("b", "h2", None, 4, "1", "t", None), ("c", "h9", None, 9, "1", "t", "bad")])
    rows = {r["file_path"]: (r["file_hash"], r["chunk_count"], r["last_error"]) for r in record_outcomes(old, done, [F.asc("file_hash")]).collect()}
    assert rows == {"a": ("h1", 3, "no text"), "b": ("h2", 4, None), "c": ("h9", 0, "bad")}


def test_retention_is_strict(spark):
    now = datetime.datetime(2024, 3, 31)
    rows = [(i, now - datetime.timedelta(days=d)) for i, d in enumerate((29, 30, 31))] + [(3, now - datetime.timedelta(days=30, microseconds=1)), (4, None)]
    chat = spark.createDataFrame(rows, "n int, created_at timestamp")
    assert sorted(r["n"] for r in retain(chat, now).collect()) == [0, 1, 4]
    assert tuple(retention_reply(chat, now).first()) == (2, 3)


def test_erasure_keeps_rows_without_a_source(spark, points):
    gone = spark.createDataFrame([("p/a",), ("p/a",)], "source string")
    kept = erase_sources({"points": (points, "source")}, gone)["points"]
    assert sorted(r["id"] for r in kept.collect()) == ["3", "4", "5", "6"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, batch int")
    expected = [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(keyed_upsert(old, new, ["k"], [F.desc("batch")]).collect()) == expected
    assert sorted(keyed_merge(old, new, ["k"], [F.desc("batch")]).collect()) == expected
    assert tuple(upsert_counts(new, ["k"]).first()) == (3, 2)


def test_keyed_table(spark):
    schema = "id string, source string, v int"
    root = shared_path(spark, "keyed")
    table = KeyedTable(spark, root, schema, ["id", "source"]).create()
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert table.read().count() == 0
    table.upsert(frame(("a", "s1", 1), ("b", "s1", 1), ("c", "s2", 1), ("d", None, 1)))
    assert table.upsert(frame(("a", "s1", 2))) == 2
    assert sorted(tuple(r) for r in table.batch(2).collect()) == [("a", "s1", 2)]
    table.upsert(frame(("e", "s2", 3)), key="source")
    assert sorted((r["id"], r["v"]) for r in table.read().collect()) == [("a", 2), ("b", 1), ("d", 1), ("e", 3)]
    table.delete("source", spark.createDataFrame([("s1",)], "s string"))
    before = sorted(table.read().select("id").collect())
    assert before == [("d",), ("e",)]
    table.compact()
    assert sorted(table.read().select("id").collect()) == before
    assert table.forget() == [1]
    again = KeyedTable(spark, root, schema, ["id", "source"]).create()
    again.upsert(frame(("a", "s1", 9)))
    assert again.read().count() == 3
    with pytest.raises(ValueError, match="lacks"):
        KeyedTable(spark, root, "id string, other int", ["id"]).create()


def test_unfinished_batch_is_not_read(spark):
    schema = "id string, v int"
    table = KeyedTable(spark, shared_path(spark, "keyed"), schema, ["id"]).create()
    table.upsert(spark.createDataFrame([("a", 1)], schema))
    lost = spark.createDataFrame([("a", 2)], schema).withColumn("_batch", F.lit(2))
    lost.write.parquet(f"{table.root}/after-1/rows/batch-2")
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    assert table.upsert(spark.createDataFrame([("a", 3)], schema)) == 2
    assert [tuple(r) for r in table.read().collect()] == [("a", 3)]


def test_hot_groups(spark):
    rows = spark.range(30_000).select((F.col("id") % 3 * 0).alias("g"), F.col("id"), (F.col("id") % 1000).alias("s"))
    order = [F.desc("s"), F.asc("id")]
    plain = top_k(rows, ["g"], order, 50).collect()
    assert sorted(plain) == sorted(top_k(rows, ["g"], order, 50, spread_by="id").collect())
    assert latest(rows, ["g"], order).first()["id"] == 999


def test_sessions(spark):
    start = datetime.datetime(2024, 1, 1, 23, 55)
    seconds = [0, 599, 1199, 1800, 1801, 90000]
    rows = [("u", start + datetime.timedelta(seconds=s)) for s in seconds]
    events = spark.createDataFrame(rows, "user string, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for width in (60, 86_400):
        found = sessions(events, "user", "ts", slice_seconds=width).orderBy("session_start").collect()
        assert [r["events"] for r in found] == [2, 1, 2, 1]


def test_images(spark):
    html = """<img src="data:image/PNG;base64,QUJD"><img alt='x' src='data:image/gif;base64,REVG\nR0g='><img src="a.png">"""
    found = extract_images(spark.createDataFrame([("h", html), ("n", None)], "file_hash string, html string")).orderBy("picture_index").collect()
    assert [(r["picture_index"], bytes(r["image_data"]), r["mimetype"]) for r in found] == [(0, b"ABC", "image/png"), (1, b"DEFGH", "image/gif")]
    row = spark.range(1).select(
        data_uri(F.lit("data:x"), F.lit(None).cast("binary")), data_uri(F.lit(None).cast("string"), F.lit(b"A" * 100).cast("binary")),
        data_uri(F.lit("f.png"), F.lit(None).cast("binary")), image_text(F.lit(" v "), F.lit(None), F.lit("k")),
    ).first()
    assert row[0] == "data:x" and row[1].startswith("data:image/png;base64,QUFB") and "\n" not in row[1] and row[2] is None
    assert row[3] == "[Image]\n[Vision] v\n[Kontext] k"


def test_markers(spark):
    texts = spark.createDataFrame([(1, "a [IMAGE:x] b [IMAGE:y][IMAGE:x] c [IMAGE:no]"), (2, "none"), (3, None)], "n int, text string")
    images = spark.createDataFrame([("x", "X"), ("y", "Y"), ("z", "Z")], "id string, uri string")
    rows = {r["n"]: r["text"] for r in resolve_markers(texts, images, "n").collect()}
    assert rows == {1: "a ![x](X) b ![y](Y)![x](X) c [IMAGE:no]", 2: "none", 3: None}


def test_routes(spark):
    questions = ["Zeig mir das Bild zu Köln", "Was ist die Summe der Kosten?", "Hallo!", "Welches Kapitel?"]
    frame = spark.createDataFrame([(q,) for q in questions], "q string")
    assert [r[0] for r in frame.select(route(F.col("q"))).collect()] == ["vector", "sql", "direct", "vector"]


def test_ingest_twice_is_ingest_once(spark):
    target = IngestTarget(shared_path(spark, "c"), shared_path(spark, "m"), dimension=8, token_budget=3)
    files = spark.createDataFrame([("a", "one two three four\nfive"), ("b", "x"), ("c", "")], "path string, text string")
    assert {r["file_path"]: r["status"] for r in ingest_batch(files, target).collect()} == {"a": "new", "b": "new", "c": "new"}
    points = collection(spark, target.collection)
    first = sorted(points.read().select("id", "text").collect())
    assert [r["text"] for r in sorted(points.read().filter("source = 'a'").collect(), key=lambda r: r["text"])] == ["four\nfive", "one two three"]
    ingest_batch(files, target)
    assert sorted(points.read().select("id", "text").collect()) == first
    ingest_batch(spark.createDataFrame([("a", "one")], "path string, text string"), target)
    assert [r["text"] for r in points.read().filter("source = 'a'").collect()] == ["one"]
    rows = {r["file_path"]: r["chunk_count"] for r in manifest_table(spark, target.manifest).read().collect()}
    assert rows == {"a": 1, "b": 1, "c": 0}
    listing = spark.createDataFrame([("a", "h"), ("c", "h")], "file_path string, file_hash string")
    assert [r["file_path"] for r in remove_missing(listing, target).collect()] == ["b"]
    assert sorted(r["file_path"] for r in manifest_table(spark, target.manifest).read().collect()) == ["a", "c"]
    assert [r["source"] for r in points.read().collect()] == ["a"]


def test_newest_version_wins_and_ties_are_recorded(spark, tmp_path):
    target = IngestTarget(str(tmp_path / "points"), str(tmp_path / "manifest"))
    rows = [("a", "first", 1), ("a", "second", 2), ("b", "only", 1), ("b", "only", 1)]
    files = spark.createDataFrame(rows, "path string, text string, at int").selectExpr("path", "text", "timestamp_seconds(at) AS modified_at")
    ingest_batch(files, target)
    texts = {r["source"]: r["text"] for r in collection(spark, target.collection).read().collect()}
    assert texts == {"a": "second", "b": "only"}
    # Two versions without times, and one without a time beside one with a time, cannot be told apart; equal ones can.
    shape = "path string, text string, modified_at timestamp"
    moment = datetime.datetime(2024, 1, 1)
    torn = [("c", "x", None), ("c", "y", None), ("a", "third", moment), ("a", "third, too", None), ("d", "good", None), ("d", "good", moment)]
    reply = {r["file_path"]: r["status"] for r in ingest_batch(spark.createDataFrame(torn, shape), target).collect()}
    assert reply == {"a": "failed", "c": "failed", "d": "new"}
    manifest = {r["file_path"]: r for r in manifest_table(spark, target.manifest).read().collect()}
    assert manifest["c"]["last_error"] == TORN and manifest["c"]["chunk_count"] == 0
    assert manifest["a"]["last_error"] == TORN and manifest["a"]["chunk_count"] == 1 and manifest["d"]["last_error"] is None
    texts = {r["source"]: r["text"] for r in collection(spark, target.collection).read().collect()}
    assert texts == {"a": "second", "b": "only", "d": "good"}
    # The next batch settles it.
    reply = {r["file_path"]: r["status"] for r in ingest_batch(spark.createDataFrame([("c", "x", None)], shape), target).collect()}
    assert set(reply) == {"c"} and manifest_table(spark, target.manifest).read().filter("last_error is not null").count() == 1


def test_compaction_leaves_no_old_bases(spark, tmp_path):
    target = IngestTarget(str(tmp_path / "points"), str(tmp_path / "manifest"), compact_every=1, keep_bases=1)
    for n in range(3):
        ingest_batch(spark.createDataFrame([("a", f"text {n}")], "path string, text string"), target)
    for folder in ("points", "manifest"):
        assert len([p for p in (tmp_path / folder).iterdir() if p.name.startswith("base-")]) == 2
    assert [r["text"] for r in collection(spark, target.collection).read().collect()] == ["text 2"]


def test_failed_file_is_recorded_and_retried(spark, tmp_path):
    target = IngestTarget(str(tmp_path / "points"), str(tmp_path / "manifest"))

    def files(content):
        rows = [("a.txt", bytearray(b"plain")), ("b.odd", bytearray(content))]
        return spark.createDataFrame(rows, "path string, content binary").selectExpr("path", "content", "md5(content) AS file_hash", "length(content) AS file_size")

    def parser(content, path):
        if content == b"broken":
            raise ValueError("cannot read it")
        return [([], content.decode(), None)]

    def state():
        manifest = {r["file_path"]: (r["chunk_count"], r["last_error"]) for r in manifest_table(spark, target.manifest).read().collect()}
        return manifest, sorted(r["text"] for r in collection(spark, target.collection).read().collect())

    ingest_files(files(b"good"), target, parser=parser)
    assert state() == ({"a.txt": (1, None), "b.odd": (1, None)}, ["good", "plain"])
    ingest_files(files(b"broken"), target, parser=parser)
    manifest, texts = state()
    assert manifest["b.odd"][0] == 1 and "cannot read it" in manifest["b.odd"][1] and texts == ["good", "plain"]
    again = {r["file_path"]: r["status"] for r in ingest_files(files(b"better"), target, parser=parser).collect()}
    assert again == {"a.txt": "unchanged", "b.odd": "modified"}
    assert state() == ({"a.txt": (1, None), "b.odd": (1, None)}, ["better", "plain"])


def test_keyed_rows_are_compressed_alike_in_batches_and_bases(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "keyed"), "id string, text string", ["id"]).create()
    table.upsert(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string"))
    table.compact()
    for folder in ("after-1/rows/batch-1", "base-2"):
        names = [p.name for p in (tmp_path / "keyed" / folder).glob("*.parquet")]
        assert names and all(name.endswith(".zstd.parquet") for name in names)
    assert sorted(r["text"] for r in table.read().collect()) == ["x", "y"]


def test_a_batch_is_not_kept_in_memory(spark, monkeypatch):
    target = IngestTarget(shared_path(spark, "c"), shared_path(spark, "m"), dimension=8)
    files = spark.createDataFrame([("a", "one two"), ("b", "x"), ("c", "y"), ("c", "z")], "path string, text string")
    kept = []
    for name in ("persist", "cache"):
        monkeypatch.setattr(type(files), name, lambda frame, *_: kept.append(frame) or frame)
    before = set(list_names(spark, shared_root(spark)))
    reply = ingest_batch(files, target)
    assert not kept
    # Of what was written on the way the reply is left.
    left = [n for n in set(list_names(spark, shared_root(spark))) - before if n.startswith("ingest-")]
    assert [list_names(spark, f"{shared_root(spark)}/{n}") for n in left] == [["changes"]]
    assert sorted(tuple(r) for r in reply.select("file_path", "status").collect()) == [("a", "new"), ("b", "new"), ("c", "failed")]


def test_a_file_that_changes_while_it_is_read_is_recorded_and_retried(spark):
    target = IngestTarget(shared_path(spark, "c"), shared_path(spark, "m"), dimension=8)
    another = F.udf(lambda: os.urandom(16).hex()).asNondeterministic()
    rows = spark.createDataFrame([("a.txt", bytearray(b"one")), ("b.txt", bytearray(b"two"))], "path string, content binary")
    rows = rows.withColumn("file_size", F.length("content"))
    ingest_files(rows.withColumn("file_hash", F.when(F.col("path") == "a.txt", another()).otherwise(F.md5("content"))), target)

    def state():
        manifest = {r["file_path"]: (r["chunk_count"], r["last_error"]) for r in manifest_table(spark, target.manifest).read().collect()}
        return manifest, sorted(r["text"] for r in collection(spark, target.collection).read().collect())

    assert state() == ({"a.txt": (0, MOVED), "b.txt": (1, None)}, ["two"])
    ingest_files(rows.withColumn("file_hash", F.md5("content")), target)
    assert state() == ({"a.txt": (1, None), "b.txt": (1, None)}, ["one", "two"])


def test_rows_that_nothing_replaced_are_only_scanned(spark):
    schema = "id string, source string, v int"
    table = KeyedTable(spark, shared_path(spark, "keyed"), schema, ["id", "source"]).create()
    for n in range(3):
        table.upsert(spark.createDataFrame([(f"i{n}", "s", n), (f"j{n}", f"t{n}", n)], schema), key="source")
    plan = table.read()._jdf.queryExecution().optimizedPlan().toString()
    # One kind of key was used, and the newest batch stands beside that join.
    assert plan.count("Join LeftAnti") == 1 and plan.startswith("Union")
    assert sorted(tuple(r) for r in table.read().collect()) == [("i2", "s", 2), ("j0", "t0", 0), ("j1", "t1", 1), ("j2", "t2", 2)]
    table.delete("id", spark.createDataFrame([("j0",)], "id string"))
    table.upsert(spark.createDataFrame([("k", "t1", 9)], schema), key="source")
    rows = [("i2", "s", 2), ("j2", "t2", 2), ("k", "t1", 9)]
    assert sorted(tuple(r) for r in table.read().collect()) == rows
    table.compact()
    assert sorted(tuple(r) for r in table.read().collect()) == rows


def test_both_vectors_are_made_by_one_worker_in_pieces(spark, monkeypatch):
    texts = spark.createDataFrame([("a", "one two two " * 50), ("b", ""), ("c", "three, one"), ("d", None)], "id string, text string")

    def points():
        return checked(build_points(texts.coalesce(1).withColumn("metadata", F.lit(None).cast("map<string,string>")), hashing_embedder(8)), 8)

    whole = sorted((r["id"], r["dense"], sorted(zip(r["terms"], r["tfs"], strict=True)), r["length"]) for r in points().collect())
    assert points()._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    monkeypatch.setattr(arrays.by_pieces, "__defaults__", (10,))
    assert sorted((r["id"], r["dense"], sorted(zip(r["terms"], r["tfs"], strict=True)), r["length"]) for r in points().collect()) == whole
    assert whole[0][2:] == ([("one", 50), ("two", 100)], 150) and whole[1][1] == [0.0] * 8


def test_compaction_deals_out_no_rows_for_keys_it_does_not_hold(spark, monkeypatch):
    schema = "id string, source string"
    table = KeyedTable(spark, shared_path(spark, "keyed"), schema, ["id", "source"]).create()
    named = [F.concat(F.lit(part), "id").alias(name) for part, name in (("i", "id"), ("s", "source"))]
    table.upsert(spark.range(0, 3000).select(*named), key="source")
    table.compact()
    table.upsert(spark.range(2999, 6000).select(F.concat(F.lit("new"), "id").alias("id"), named[1]), key="source")
    plans, write = [], KeyedTable._write_base
    monkeypatch.setattr(KeyedTable, "_write_base", lambda self, rows, n: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows, n))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        assert "SortMergeJoin" in table.read()._jdf.queryExecution().executedPlan().toString()
        table.compact()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plans[0]
    rows = {r["source"]: r["id"] for r in table.read().collect()}
    assert len(rows) == table.read().count() == 6000 and rows["s2998"] == "i2998" and rows["s2999"] == "new2999"
