"""The whole way: files to chunks to a collection, tables, answers, erasure."""

from __future__ import annotations

import pathlib

import pyarrow as pa
from pyspark.sql import functions as F

from tabularium.functions.payload import payload
from tabularium.operators.search import SearchOptions
from tabularium.session import shared_path
from tabularium.workspace import Workspace


def test_documents_and_tables(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/rhein.txt").write_text("Der Rhein fließt durch Köln.\nEr mündet in die Nordsee.")
    (tmp_path / "docs/auto.html").write_text("<h1>Autos</h1><p>Elektrofahrzeuge fahren leise.</p>")
    (tmp_path / "docs/scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "kosten.csv").write_text("Abteilung;Betrag\n".replace(";", ",") + "Sales,10\nMarketing,20\n")
    space = Workspace(spark, shared_path(spark, "space"), dimension=16)

    chunks = space.chunk_files(str(tmp_path / "docs"))
    assert chunks.count() == 2
    status = {r["path"].rsplit(".", 1)[1]: r["status"] for r in space.export_files(str(tmp_path / "docs")).collect()}
    assert status == {"txt": "success", "html": "success", "pdf": "failure"}

    meta = F.create_map(
        F.lit("source"), F.col("path"), F.lit("fileHash"), F.col("file_hash"),
        F.lit("fileSize"), F.col("file_size").cast("string"), F.lit("contentType"), F.lit("doc"),
    )
    items = chunks.select(F.lit(None).cast("string").alias("id"), "text", meta.alias("metadata"))
    assert tuple(space.upsert(items).first()) == (2, 2)
    space.upsert(items)
    assert space.collection().read().count() == 2

    asked = spark.createDataFrame([(1, "Wohin fließt der Rhein?"), (2, "Elektrofahrzeuge")], "query_id int, query string")
    best = {r["query_id"]: r for r in space.search(asked, SearchOptions(limit=1, dimension=16)).collect()}
    assert "Nordsee" in best[1]["text"] and best[2]["text"].startswith("Autos\n")
    assert best[1]["metadata"]["source"].endswith("rhein.txt")

    assert tuple(space.reconcile().first()) == (2, 2)
    assert space.manifest_count() == 2
    assert tuple(space.ingest_stats().first())[:2] == (2, 2)

    table = space.ingest_table(str(tmp_path / "kosten.csv"), "in/kosten.csv", "h").first()
    found = space.search_tables(asked.limit(1).withColumn("query", F.lit("Abteilung Betrag")), SearchOptions(limit=3, rerank=True, dimension=16))
    assert found.first()["id"] == table["table_id"]
    package = space.query_tables("SELECT sum(betrag) AS s FROM kosten", [table["table_id"]]).first()
    assert package["rows"] == ['{"s":30}']

    assert space.erase_source("in/kosten.csv") == [table["table_id"]]
    source = best[1]["metadata"]["source"]
    space.erase_source(source)
    assert space.collection().read().count() == 1 and space.manifest_count() == 1
    left = [p for p in pathlib.Path(space.root).rglob("*") if p.is_dir() and p.name.startswith("after-")]
    assert not left


def test_prepared_search_gives_the_same_hits(spark, small):
    space = Workspace(spark, shared_path(spark, "space"), dimension=16)
    documents = spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("source"), F.col("source")).alias("metadata")
    )
    asked = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    options = SearchOptions(limit=4, dimension=16)
    space.upsert(documents)
    plain = sorted(space.search(asked, options).drop("metadata").collect())
    space.prepare_search(cells=5)
    assert sorted(space.search(asked, options).drop("metadata").collect()) == plain
    space.upsert(documents.limit(1).withColumn("text", F.lit("entirely new words")))
    found = space.search(spark.createDataFrame([(1, "entirely new words")], "query_id int, query string"), options)
    assert found.filter("rank = 1").first()["text"] == "entirely new words"


def test_prepared_table_search_gives_the_same_hits(spark, tmp_path):
    space = Workspace(spark, shared_path(spark, "space"), dimension=16)
    files = []
    for n, header in enumerate(("Abteilung,Betrag", "Stadt,Einwohner", "Fluss,Abfluss")):
        (tmp_path / f"t{n}.csv").write_text(f"{header}\nx,{n}\n")
        files.append((str(tmp_path / f"t{n}.csv"), f"in/t{n}.csv", "h"))
    space.ingest_tables(spark.createDataFrame(files, "path string, source_path string, file_hash string"))
    asked = spark.createDataFrame([(1, "Einwohner der Stadt"), (2, "Fluss")], "query_id int, query string")
    options = SearchOptions(limit=3, dimension=16)
    plain = sorted(space.search_tables(asked, options).drop("metadata").collect())
    space.prepare_table_search(cells=2)
    assert list(pathlib.Path(space.root, "search-tables").iterdir())
    assert sorted(space.search_tables(asked, options).drop("metadata").collect()) == plain and plain
    space.compact()
    assert len([p for p in pathlib.Path(space.root, "collections/documents").iterdir() if p.name.startswith("base-")]) == 2


def test_rows_of_one_id_are_chosen_before_they_are_encoded(spark, tmp_path):
    rows = [("a", f"text {i}", {"source": f"s{i}"}) for i in range(5)]
    documents = spark.createDataFrame(rows, "id string, text string, metadata map<string,string>")
    kept = documents.orderBy(F.xxhash64(payload(F.col("text"), F.col("metadata")))).first()["text"]

    @F.arrow_udf("array<float>")
    def only_kept(texts):
        assert texts.to_pylist() == [kept] * len(texts), "a row that is not kept was encoded"
        return pa.array([[1.0, 0.0]] * len(texts), pa.list_(pa.float32()))

    space = Workspace(spark, str(tmp_path / "space"), 2, only_kept)
    counts = space.upsert(documents)
    assert [r["text"] for r in space.collection().read().collect()] == [kept] and sorted(counts.first()) == [1, 5]
