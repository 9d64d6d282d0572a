"""Images, logs and erasure on storage; hot image markers."""

from __future__ import annotations

import base64
import datetime
import pathlib
import struct

import pytest
from pyspark.sql import functions as F

from tabularium.operators.images import markers, resolve_markers, salted
from tabularium.session import shared_path
from tabularium.sources.imagestore import ImageStore, size_of_image
from tabularium.sources.logs import append_log, erase_from_log, read_log, retain_log
from tabularium.workspace import Workspace

PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480) + b"rest"
GIF = b"GIF89a" + struct.pack("<HH", 3, 2) + b"rest"
BMP = b"BM" + bytes(16) + struct.pack("<ii", 7, -9) + b"rest"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 20, 30) + b"rest"


@pytest.mark.parametrize(("data", "size"), [(PNG, (640, 480)), (GIF, (3, 2)), (BMP, (7, 9)), (JPEG, (30, 20)), (b"text that is none", None), (b"", None), (None, None), (PNG[:20], None), (JPEG[:12], None)])
def test_sizes(data, size):
    assert size_of_image(data) == size


def page(*images):
    return "".join(f"<img src='data:image/{kind};base64,{base64.b64encode(data).decode()}'>" for kind, data in images)


def test_image_store(spark):
    store = ImageStore(spark, shared_path(spark, "images"))
    shape = "source string, file_hash string, html string"
    pages = [("a", "h1", page(("png", PNG), ("gif", GIF))), ("b", "h2", page(("png", PNG), ("jpeg", JPEG))), ("c", "h3", "no image"), ("d", "h4", page(("png", PNG)))]
    store.add(spark.createDataFrame(pages, shape))
    counts = sorted(r["references"] for r in store.counts().collect())
    assert counts == [1, 1, 3] and store.contents.read().count() == 3
    rows = {(r["source"], r["picture_index"]): r for r in store.read().collect()}
    assert (rows["a", 0]["width"], rows["a", 0]["height"], bytes(rows["a", 0]["image_data"])) == (640, 480, PNG)
    assert (rows["b", 1]["width"], rows["b", 1]["mimetype"]) == (30, "image/jpeg")
    # A changed file loses its old images; their bytes stay as long as others have them.
    store.add(spark.createDataFrame([("a", "h5", page(("png", PNG)))], shape))
    assert store.references.read().filter("source = 'a'").count() == 1 and store.contents.read().count() == 2
    store.erase(spark.createDataFrame([("b",), ("nobody",)], "source string"))
    assert {r["source"] for r in store.read().collect()} == {"a", "d"} and store.contents.read().count() == 1
    store.erase(spark.createDataFrame([("a",), ("d",)], "source string"))
    assert store.contents.read().count() == 0
    # Not even the bytes are left.
    assert not [p for p in pathlib.Path(store.root).rglob("*.parquet") if PNG in p.read_bytes()]


def log(spark):
    root = shared_path(spark, "log")
    moments = [datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day) for day in range(6) for hour in (0, 12, 23)]
    rows = [(i, f"s{i % 4}", m) for i, m in enumerate(moments)] + [(99, "s1", None)]
    append_log(spark.createDataFrame(rows, "id int, source string, created_at timestamp"), root)
    return root


def test_retention(spark):
    root = log(spark)
    untouched = {p: p.stat().st_mtime_ns for p in pathlib.Path(root).rglob("day=2024-01-0[56]/*.parquet")}
    reply = retain_log(spark, root, datetime.datetime(2024, 1, 13, 12), days=10).first()
    assert tuple(reply) == (7, 12)
    kept = read_log(spark, root)
    assert sorted(r["id"] for r in kept.collect()) == [*range(7, 18), 99]
    assert sorted(p.name for p in pathlib.Path(root).iterdir() if p.name.startswith("day=")) == ["day=2024-01-03", "day=2024-01-04", "day=2024-01-05", "day=2024-01-06", "day=__HIVE_DEFAULT_PARTITION__"]
    assert untouched and all(p.stat().st_mtime_ns == t for p, t in untouched.items())
    assert tuple(retain_log(spark, root, datetime.datetime(2024, 1, 13, 12), days=10).first()) == (0, 12)
    # The whole boundary day may go, and all days.
    assert tuple(retain_log(spark, root, datetime.datetime(2024, 1, 13, 23, 30), days=10).first()) == (2, 10)
    assert tuple(retain_log(spark, root, datetime.datetime(2025, 1, 1), days=1).first()) == (9, 1)


def test_retention_of_nothing(spark):
    assert tuple(retain_log(spark, shared_path(spark, "log"), datetime.datetime(2024, 1, 1)).first()) == (0, 0)


def test_erasure_from_a_log(spark):
    root = log(spark)
    gone = spark.createDataFrame([("s1",), ("nobody",)], "source string")
    assert erase_from_log(spark, root, "source", gone) == 6
    left = [r["source"] for r in read_log(spark, root).collect()]
    assert len(left) == 13 and "s1" not in left
    assert erase_from_log(spark, root, "source", gone) == 0
    assert erase_from_log(spark, root, "source", spark.createDataFrame([(f"s{i}",) for i in range(4)], "source string")) == 13


def test_erasure_over_all_stores(spark, tmp_path):
    space = Workspace(spark, shared_path(spark, "space"), dimension=16)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<p>Der Rhein</p>" + page(("png", PNG)))
    (tmp_path / "in/b.txt").write_text("Die Elbe")
    space.ingest_files(str(tmp_path / "in"))
    sources = sorted(r["file_path"] for r in space.manifest.read().collect())
    space.images.add(spark.createDataFrame([(sources[0], "h", page(("png", PNG)))], "source string, file_hash string, html string"))
    space.append_log("questions", spark.createDataFrame([(s, datetime.datetime(2024, 1, 1)) for s in sources], "source string, created_at timestamp"))
    space.append_log("chat", spark.createDataFrame([("hi", datetime.datetime(2024, 1, 1))], "message string, created_at timestamp"))
    report = {r["store"]: r["erased"] for r in space.erase_sources(spark.createDataFrame([(sources[0],)], "source string")).collect()}
    assert report == {"collection documents": 1, "manifest": 1, "table registry": 0, "table cards": 0, "images": 1, "log questions": 1}
    assert [r["source"] for r in space.collection().read().collect()] == [sources[1]]
    held = [p for p in pathlib.Path(space.root).rglob("*.parquet") if b"Rhein" in p.read_bytes() or sources[0].encode() in p.read_bytes()]
    assert not held


def test_what_is_left_stops_the_erasure(spark, monkeypatch):
    space = Workspace(spark, shared_path(spark, "space"), dimension=16)
    space.append_log("questions", spark.createDataFrame([("a", datetime.datetime(2024, 1, 1))], "source string, created_at timestamp"))
    monkeypatch.setattr("tabularium.workspace.erase_from_log", lambda *_: 0)
    with pytest.raises(RuntimeError, match="log questions"):
        space.erase_sources(spark.createDataFrame([("a",)], "source string"))


def test_hot_marker_is_spread(spark):
    texts = spark.range(4000).select(F.col("id").alias("key"), F.concat(F.lit("[IMAGE:logo] text [IMAGE:"), "id", F.lit("][IMAGE:none]")).alias("text"))
    images = spark.createDataFrame([("logo", "u:logo"), ("logo", "u:logo2"), ("7", "u7"), ("8", None)], "id string, uri string")
    pairs, hot = salted(markers(texts, "key"), "key", shares=16)
    assert {r["image_id"]: r["salts"] for r in hot.collect()} == {"logo": 6, "none": 6}
    sizes = [r["n"] for r in pairs.groupBy("image_id", "salt").agg(F.count("*").alias("n")).collect() if r["n"] > 1]
    assert len(sizes) == 12 and max(sizes) <= 2 * sorted(sizes)[6]
    rows = {r["key"]: r["text"] for r in resolve_markers(texts, images, "key").collect()}
    assert rows[7] == "![logo](u:logo) text ![7](u7)[IMAGE:none]" and rows[8] == "![logo](u:logo) text [IMAGE:8][IMAGE:none]" and len(rows) == 4000
    none = texts.select("key", F.lit("no marker").alias("text"))
    assert {r["text"] for r in resolve_markers(none, images, "key").collect()} == {"no marker"}
    assert resolve_markers(texts.limit(0), images, "key").count() == 0
