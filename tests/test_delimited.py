"""Delimited files in splits against one-task readers, and folders of unlike files."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabularium.session import shared_path
from tabularium.sources.delimited import cells_of, read_delimited, read_records
from tabularium.sources.tablestore import FILES, TableStore


def in_splits(spark, size):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    return session


def records(session, path, delimiter=","):
    return [r["cells"] for r in sorted(read_records(session, str(path), delimiter).collect(), key=lambda r: (r["file"], r["split"], r["number"]))]


def random_rows(seed, n, longest):
    draw = random.Random(seed)

    def cell():
        return "".join(draw.choice(["a", "ß", ",", '"', "\n", " ", "x\ny", '""', "\t"]) for _ in range(draw.choice([0, 1, 3, 10, longest])))

    return [[cell() for _ in range(draw.randint(1, 5))] for _ in range(n)]


@pytest.mark.parametrize(("size", "seed", "end"), [(150, 1, "\n"), (400, 2, "\r\n"), (1 << 20, 4, "\r\n")])
def test_splits_give_the_records_of_one_reader(spark, tmp_path, size, seed, end):
    rows = random_rows(seed, 40, 300)
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(rows)
    content = text.getvalue()
    path = tmp_path / "a.csv"
    path.write_bytes(content.encode())
    session = in_splits(spark, size)
    if size < 1000:
        assert read_records(session, str(path)).select("split").distinct().count() > 3
    expected = [[c or None for c in row] for row in csv.reader(io.StringIO(content, newline="")) if row]
    assert records(session, path) == expected


def test_awkward_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿"Na\nme",b\n\n\r\n"x ""y"" z","1\r\n2"\r\n,\nopen,"never closed\nand on'.encode())
    expected = [["Na\nme", "b"], ['x "y" z', "1\r\n2"], [None, None], ["open", "never closed\nand on"]]
    for size in (1 << 20, 16, 5):
        assert records(in_splits(spark, size), path) == expected
    frame = read_delimited(in_splits(spark, 16), str(path))
    assert frame.columns == ["na_me", "b"] and frame.count() == 3
    (tmp_path / "blank.csv").write_text("\n\n")
    assert read_delimited(spark, str(tmp_path / "blank.csv")) is None


def test_one_cell_over_many_splits(spark, tmp_path):
    long = "\n".join(f'line {i} "quoted", and more' for i in range(120))
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["k", "v"], ["1", long], ["2", "short"], ["3", long]])
    path = tmp_path / "long.csv"
    path.write_text(text.getvalue())
    session = in_splits(spark, 512)
    assert records(session, path) == [["k", "v"], ["1", long], ["2", "short"], ["3", long]]


def test_parts_meet_by_record_and_splits_share_tasks(spark, tmp_path):
    rows = [["k", "v"], *([str(i), "\n".join(f'line {j} "of" {i}' for j in range(i * 7 % 90))] for i in range(60)), ["", "a\n"]]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(text.getvalue())
    session = in_splits(spark, 256)
    session.conf.set("spark.sql.files.maxPartitionNum", "3")
    found = read_records(session, str(tmp_path))
    # No task sorts the texts of a whole file.
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select("split").distinct().count() > 20
    assert records(session, tmp_path) == 2 * [[cell or None for cell in row] for row in rows]


@pytest.mark.parametrize("record", ["a,b", "", "\r", '"a,b",c', '"",""', 'a"b,c"d', '"a""', ",,", '"x"y,z'])
def test_cells_keep_their_delimiters(record):
    cells = cells_of(record, ",")
    plain = record.removesuffix("\r")
    assert len(cells) == (0 if not plain else len(next(csv.reader([plain]))) if plain.count('"') % 2 == 0 and plain not in ('a"b,c"d',) else 1)


CONTENT = {
    "costs.csv": "Abteilung,Q1,Since\nSales,1,2024-01-01\nMarketing,,2024-02-30\nOps,3,\n",
    "stock.tsv": "Art\tArt\t\n\"a\nb\"\t1.5\tja\nx\t2\tnein\tcut\n",
    "header.csv": "only,headers\n",
    "empty.csv": "",
    "wide.csv": ",".join(f"c{i}" for i in range(60)) + "\n" + ",".join(str(i) for i in range(60)) + "\n",
}


def folder(tmp_path, copies=1):
    files = []
    for n in range(copies):
        for name, content in CONTENT.items():
            path = tmp_path / f"part {n} ä%"
            path.mkdir(exist_ok=True)
            (path / name).write_text(content)
            files.append((str(path / name), f"in/{n}/{name}", f"h{n}"))
    return files


def test_unlike_files(spark, tmp_path):
    store = TableStore(spark, shared_path(spark, "store"))
    files = [*folder(tmp_path), ("nowhere", "in/x.json", "h")]
    reply = {r["source_path"]: r for r in store.ingest_all(spark.createDataFrame(files, FILES)).collect()}
    assert set(reply) == {"in/0/costs.csv", "in/0/stock.tsv", "in/0/header.csv", "in/0/wide.csv", "in/x.json"}
    assert reply["in/x.json"]["error"] == "Unsupported table file format: .json" and reply["in/x.json"]["table_id"] is None
    assert {(r["table_name"], r["row_count"], r["column_count"]) for r in reply.values() if not r["error"]} == {("costs", 3, 3), ("stock", 2, 3), ("header", 0, 2), ("wide", 1, 60)}
    costs = store.read(reply["in/0/costs.csv"]["table_id"])
    assert costs.columns == ["abteilung", "q1", "since", "_rescued"]
    rows = {r["abteilung"]: r for r in costs.collect()}
    assert rows["Sales"]["q1"] == 1 and str(rows["Sales"]["since"]) == "2024-01-01" and rows["Marketing"]["q1"] is None
    assert rows["Marketing"]["since"] == "2024-02-30" or rows["Marketing"]["_rescued"] == {"since": "2024-02-30"}
    stock = {r["art"]: r for r in store.read(reply["in/0/stock.tsv"]["table_id"]).collect()}
    assert stock["a\nb"]["art_2"] == 1.5 and stock["a\nb"]["col_2"] is True and stock["x"]["col_2"] is False
    assert store.read(reply["in/0/header.csv"]["table_id"]).count() == 0
    wide = store.read(reply["in/0/wide.csv"]["table_id"]).first()
    assert [wide[f"c{i}"] for i in range(60)] == list(range(60))
    assert store.cards.read().count() == 4


def test_jobs_do_not_depend_on_the_number_of_files(spark, tmp_path):
    def jobs(copies):
        store = TableStore(spark, shared_path(spark, "store"))
        files = spark.createDataFrame(folder(tmp_path, copies), FILES)
        group = f"ingest {copies}"
        spark.sparkContext.setJobGroup(group, group)
        store.ingest_all(files)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert store.registry.read().count() == 4 * copies
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, many = jobs(1), jobs(6)
    assert abs(many - one) <= 0.2 * one


def test_describer_of_a_batch(spark, tmp_path):
    store = TableStore(spark, shared_path(spark, "store"))

    def describer(card):
        return F.when(F.contains(card, F.lit("Abteilung".lower())), F.lit('{"description": "Costs", "columns": [{"name": "q1", "type": "text", "description": "euros"}]}')).otherwise(F.lit("no json"))

    reply = {r["source_path"]: r for r in store.ingest_all(spark.createDataFrame(folder(tmp_path), FILES), describer).collect()}
    assert reply["in/0/costs.csv"]["description"] == "Costs" and reply["in/0/stock.tsv"]["description"] == "Table from stock.tsv"
    assert {r["q1"] for r in store.read(reply["in/0/costs.csv"]["table_id"]).collect()} == {"1", "3", None}


def test_a_hot_name_stays_free(spark):
    from tabularium.operators.tables import name_tables

    shape = "table_id string, source_path string, sheet_name string"
    ids = ["aaaaaaaa1", "aaaaaaaa2", "aaaaaaaa3", "bbbbbbbb1"]
    incoming = spark.createDataFrame([(ids[0], "x/a.csv", None), (ids[1], "y/a.csv", None), (ids[2], "z/a.csv", None), (ids[3], "w/a.csv", None)], shape)
    registry = spark.createDataFrame([("other", "a_bbbbbbbb")], "table_id string, table_name string")
    named = {r["table_id"]: r["table_name"] for r in name_tables(incoming, registry).collect()}
    assert named == {ids[0]: "a", ids[1]: "a_aaaaaaaa", ids[2]: f"a_{ids[2]}", ids[3]: f"a_{ids[3]}"}


def test_records_get_their_table_without_a_shuffle_by_file(spark, tmp_path):
    from tabularium.sources import tablestore
    from tabularium.sources.delimited import records_and_files

    folder = tmp_path / "parts"
    folder.mkdir()
    for n in range(3):
        (folder / f"p{n} ü.csv").write_text(f'a,b\n{n},"x\ny"\n')
    single = tmp_path / "one.csv"
    single.write_text("a\n7\n")
    records, names = records_and_files(spark, [str(folder), str(single)])
    assert len(names) == 4
    placed = tablestore._with_table(records, names, [(f"file:{folder}", "many"), (f"file:{single}", "one")])
    # Only the small lists of files and roots may meet by a sort.
    assert "BroadcastHashJoin [file#" in placed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["table_id"], r["cells"][0]) for r in placed.collect()) == [("many", "0"), ("many", "1"), ("many", "2"), ("many", "a"), ("many", "a"), ("many", "a"), ("one", "7"), ("one", "a")]
