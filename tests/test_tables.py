from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tabularium.functions.coercion import coerce
from tabularium.functions.text import file_extension, file_stem, identifier
from tabularium.operators.sqlguard import RejectedStatement, answer, audit, run_guarded
from tabularium.operators.tables import (
    base_name,
    infer_types,
    label_map,
    name_tables,
    parse_description,
    typed_table,
)
from tabularium.session import shared_path
from tabularium.sources.delimited import column_names, read_delimited
from tabularium.sources.tablestore import TableStore, UnsupportedFormat
from tabularium.sources.workbook import workbook_rows

RESCUED = object()
VALUES = {
    " 42 ": (42, 42.0, False, RESCUED),
    "3.9": (3, 3.9, False, RESCUED),
    "-3.9": (-3, -3.9, False, RESCUED),
    "1e3": (1000, 1000.0, False, RESCUED),
    "1e30": (RESCUED, 1e30, False, RESCUED),
    "inf": (RESCUED, RESCUED, False, RESCUED),
    "1d": (RESCUED, RESCUED, False, RESCUED),
    "1_000": (RESCUED, RESCUED, False, RESCUED),
    "1,5": (RESCUED, RESCUED, False, RESCUED),
    "9007199254740993": (9007199254740993, 9007199254740992.0, False, RESCUED),
    "": (None, None, None, None),
    "None": (None, None, None, None),
    " NULL": (None, None, None, None),
    "nan": (None, None, None, None),
    "yes": (RESCUED, RESCUED, True, RESCUED),
    "ja": (RESCUED, RESCUED, True, RESCUED),
    "True": (RESCUED, RESCUED, True, RESCUED),
    "0": (0, 0.0, False, RESCUED),
    "2024-02-30": (RESCUED, RESCUED, False, RESCUED),
    "2024-02-29": (RESCUED, RESCUED, False, datetime.date(2024, 2, 29)),
    "200K": (RESCUED, RESCUED, False, RESCUED),
}
TYPES = ("INTEGER", "REAL", "BOOLEAN", "DATE")


def test_coercion(spark):
    cells = spark.createDataFrame([(v, v, v, v, v) for v in VALUES], ["raw", *TYPES])
    for row in typed_table(cells, {t: t for t in TYPES}).collect():
        for kind, expected in zip(TYPES, VALUES[row["raw"] or ""] if row["raw"] else (None,) * 4, strict=True):
            kept = (row["_rescued"] or {}).get(kind)
            if expected is RESCUED:
                assert row[kind] is None and kept == row["raw"], (row["raw"], kind)
            else:
                assert row[kind] == expected and kept is None, (row["raw"], kind)


def test_magnitudes(spark):
    cells = spark.createDataFrame([("200K",), ("1.5m",), ("2B",), ("K",)], ["c"])
    values = [r[0] for r in cells.select(coerce(F.col("c"), "INTEGER", magnitude_suffix=True)).collect()]
    assert values == [200_000, 1_500_000, 2_000_000_000, None]


def test_inference(spark):
    rows = [("1", "1", "x", "ja", "2024-01-01", None, "1.5"), ("2", "2.5", "3", "NEIN", "null", "nan", "1e2")]
    cells = spark.createDataFrame(rows, "i string, r string, t string, b string, d string, e string, f string")
    assert label_map(infer_types(cells)) == {
        "i": "INTEGER", "r": "REAL", "t": "TEXT", "b": "BOOLEAN", "d": "DATE", "e": "TEXT", "f": "REAL",
    }


@pytest.mark.parametrize(
    ("name", "expected"),
    [("Größe (m²)", "gr_e_m"), ("2024 Sales", "t_2024_sales"), ("", "t_"), ("___", "t_"), ("x" * 80, "x" * 64), ("A__b-", "a_b")],
)
def test_identifier(spark, name, expected):
    assert spark.range(1).select(identifier(F.lit(name))).first()[0] == expected


def test_paths(spark):
    row = spark.range(1).select(
        file_stem(F.lit("a/b.c.CSV")), file_extension(F.lit("a/b.c.CSV")), file_extension(F.lit("a.d/b")),
        file_stem(F.lit("x/.env")), base_name(F.lit("Umsatz 1.xlsx"), F.lit("Blatt A")),
    ).first()
    assert tuple(row) == ("b.c", ".csv", "", ".env", "umsatz_1_blatt_a")


def test_names_collide(spark):
    shape = "table_id string, source_path string, sheet_name string"
    incoming = spark.createDataFrame([("bbbbbbbbbb", "x/a.csv", None), ("aaaaaaaaaa", "y/a.csv", ""), ("cccccccccc", "taken.csv", None), ("dddddddddd", "own.csv", None)], shape)
    registry = spark.createDataFrame([("zz", "taken"), ("dddddddddd", "own")], "table_id string, table_name string")
    named = {r["table_id"][0]: r["table_name"] for r in name_tables(incoming, registry).collect()}
    assert named == {"a": "a", "b": "a_bbbbbbbb", "c": "taken_cccccccc", "d": "own"}


def test_column_names(spark):
    assert column_names(spark, ["a", "A", None, "a_2", "1", "ä"]) == ["a", "a_2", "col_2", "a_2_2", "col_1", "col_"]


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿Name,Größe,Größe\n"x, y","line 1\nline 2",3\n\nshort\na,b,c,long\n"say ""hi""",,\n'.encode())
    frame = read_delimited(spark, str(path))
    assert frame.columns == ["name", "gr_e", "gr_e_2"]
    assert [tuple(r) for r in frame.collect()] == [
        ("x, y", "line 1\nline 2", "3"), ("short", None, None), ("a", "b", "c"), ('say "hi"', None, None),
    ]


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "header.csv").write_text("a,b\n")
    (tmp_path / "empty.csv").write_text("")
    assert read_delimited(spark, str(tmp_path / "header.csv")).count() == 0
    assert read_delimited(spark, str(tmp_path / "empty.csv")) is None


def test_store(spark, tmp_path):
    (tmp_path / "Kosten.csv").write_text("Abteilung,Q1,Q2\nMarketing,150000,200000\nSales,300000,350000\nFulfillment,500000,480000\n")
    (tmp_path / "leer.csv").write_text("")
    store = TableStore(spark, shared_path(spark, "store"))
    first = store.ingest(str(tmp_path / "Kosten.csv"), "in/Kosten.csv", "h1").first()
    assert (first["table_name"], first["row_count"], first["column_count"]) == ("kosten", 3, 3)
    assert store.ingest(str(tmp_path / "leer.csv"), "in/leer.csv", "h0").count() == 0
    with pytest.raises(UnsupportedFormat):
        store.ingest(str(tmp_path / "x.json"), "in/x.json", "h0")
    again = store.ingest(str(tmp_path / "Kosten.csv"), "in/Kosten.csv", "h2").first()
    assert again["table_id"] == first["table_id"] and store.registry.read().count() == 1
    other = store.ingest(str(tmp_path / "Kosten.csv"), "out/Kosten.csv", "h1").first()
    assert other["table_name"] == f"kosten_{other['table_id'][:8]}"
    schemas = store.schemas([first["table_id"], "unknown"])
    package = answer(spark, "SELECT SUM(q2) AS total FROM kosten;", schemas, store.readers(schemas)).first()
    assert (package["status"], package["rows"], package["row_count"]) == ("ok", ['{"total":1030000}'], 1)
    assert package["citations"] == ["[Quelle: in/Kosten.csv, Tabelle: kosten]"]
    assert answer(spark, "SELECT 1", store.schemas(["unknown"]), {}).first()["error"].startswith("No valid tables")
    wrong = answer(spark, "SELECT nothing FROM kosten", schemas, store.readers(schemas)).first()
    assert wrong["status"] == "error" and "SQL execution error" in wrong["error"]
    card = store.cards.read().filter(F.col("source") == "in/Kosten.csv").first()
    assert card["text"].startswith("Table from Kosten.csv\n\nColumns: abteilung, q1, q2\n\nSample data:\nabteilung | q1 | q2\nMarketing | 150000 | 200000\n")
    assert store.delete_source("in/Kosten.csv") == [first["table_id"]]
    assert [r["table_id"] for r in store.registry.read().collect()] == [other["table_id"]]
    assert store.cards.read().count() == 1


STATEMENTS = {
    "SELECT * FROM a": None,
    " select * from A ;; ": None,
    "SELECT 1; SELECT 2": "multiple statements",
    "; ;": "multiple statements",
    "WITH x AS (SELECT 1) SELECT * FROM x": "not a SELECT",
    "SELECT 'delete' FROM a": "forbidden keyword",
    "SELECT created_at, dropped FROM a": None,
    "SELECT REPLACE(x, 'a', 'b') FROM a": "forbidden keyword",
    "SELECT * FROM sqlite_master": "internal table",
    "SELECT * FROM nope JOIN b ON 1=1": "unknown tables: nope",
    "SELECT 'from nowhere' FROM a": None,
    "SELECT EXTRACT(year FROM ts) FROM a": None,
    "SELECT a IS NOT DISTINCT FROM b FROM a": None,
    "SELECT * FROM a, secret": "unknown tables: secret",
    "SELECT * FROM a /* , b */ -- JOIN c\n, \"B\"": None,
    "SELECT '--' AS x FROM a, secret": "unknown tables: secret",
    "SELECT TRANSFORM(x) USING 'tr 0-9 a-j' AS (y string) FROM a": "script transformation",
    "SELECT transform(x, y -> y + 1) FROM a JOIN b USING (x)": None,
    "SELECT * FROM global_temp.secret": "unknown tables: global_temp.secret",
    "SELECT * FROM (a JOIN (SELECT 1 FROM hidden) h), b": "unknown tables: hidden",
    "SELECT reflect('java.lang.System', 'nanoTime') FROM a": "forbidden function",
    "SELECT * FROM parquet.`/tmp/x`": "unknown tables: parquet./tmp/x",
}


@pytest.mark.parametrize("extra", [0, 400])
def test_audit(spark, extra):
    """One path, however many tables are known; statements need no key.""" 
    statements = spark.createDataFrame(list(enumerate(STATEMENTS)), "stmt_id int, sql string")
    known = spark.createDataFrame([("a",), ("b",), *[(f"t{i}",) for i in range(extra)]], "table_name string")
    judged = {r["sql"]: r["reject_reason"] for r in audit(statements, known).collect()}
    assert judged == STATEMENTS


def test_guarded_run(spark, small):
    tables = {"nation": f"{small}/nation.parquet", "lineitem": f"{small}/lineitem.parquet"}
    everything = spark.read.parquet(tables["lineitem"]).count()
    assert run_guarded(spark, "SELECT * FROM lineitem", tables).count() == everything
    assert run_guarded(spark, "SELECT * FROM lineitem LIMIT 1000", tables).count() == 1000
    assert run_guarded(spark, "SELECT * FROM lineitem LIMIT 1000", tables, max_rows=200).count() == 200
    assert run_guarded(spark, 'SELECT "n_name" FROM nation LIMIT 3;', tables).count() == 3
    spark.read.parquet(f"{small}/region.parquet").createOrReplaceTempView("hidden")
    spark.read.parquet(f"{small}/region.parquet").createOrReplaceGlobalTempView("seen")
    for sql in (
        "SELECT * FROM nation, hidden", "SELECT * FROM nation, global_temp.seen", "DROP TABLE nation",
        f"SELECT * FROM nation, parquet.`{small}/region.parquet`",
        "SELECT reflect('java.lang.System', 'nanoTime') FROM nation", "SELECT FROM WHERE nation",
        "SELECT TRANSFORM(n_name) USING 'tr a b' AS (x string) FROM nation", "SELECT * FROM nation, range(5)",
        "SELECT * FROM nation WHERE n_name IN (SELECT r_name FROM global_temp.seen)", "SELECT input_file_name() FROM nation",
    ):
        with pytest.raises(RejectedStatement):
            run_guarded(spark, sql, tables)


@pytest.mark.parametrize("sql", [
    "SELECT TRANSFORM(n_name) USING 'tr a b' AS (x string) FROM nation", "SELECT * FROM nation, global_temp.seen",
    "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM global_temp.seen)", "SELECT * FROM nation, range(5)",
    "SELECT java_method('java.lang.System', 'nanoTime') FROM nation",
])
def test_plan_check_stands_alone(spark, small, monkeypatch, sql):
    """What the text check would miss is caught on the plan."""
    monkeypatch.setattr("tabularium.operators.sqlguard.audit", lambda statements, known: statements.selectExpr("sql AS cleaned_sql", "CAST(NULL AS STRING) AS reject_reason"))
    spark.read.parquet(f"{small}/region.parquet").createOrReplaceGlobalTempView("seen")
    with pytest.raises(RejectedStatement):
        run_guarded(spark, sql, {"nation": f"{small}/nation.parquet"})


def test_describer_reply(spark):
    rows = [('{"description":"d","columns":[{"name":"a","type":"INTEGER"}]}',), ("not json",), ("{}",), (None,)]
    frame = spark.createDataFrame(rows, "reply string")
    parsed = [r[0] for r in frame.select(parse_description(F.col("reply"), F.lit("plain"), F.array(F.lit("a"), F.lit("b")))).collect()]
    assert [p["description"] for p in parsed] == ["d", "plain", "plain", "plain"]
    assert [len(p["columns"]) for p in parsed] == [1, 2, 0, 2]
    assert [p["error"] for p in parsed] == [None, "malformed reply", None, "malformed reply"]


def test_unreadable_workbook_is_a_record(spark):
    files = spark.createDataFrame([("a.xlsx", b"x")], "path string, content binary")

    def reader(content):
        raise ValueError("no workbook")

    row = workbook_rows(files, reader).first()
    assert (row["path"], row["error"], row["cells"]) == ("a.xlsx", "no workbook", None)


def test_describer_reply_is_used(spark, tmp_path):
    file = tmp_path / "costs.csv"
    file.write_text("a,b\n1,2\n3,4\n5,6\n")
    store = TableStore(spark, str(tmp_path / "store"))

    def describer(card):
        return F.lit('{"description": "Costs by year", "columns": [{"name": "b", "type": "TEXT", "description": "euros"}, {"name": "x", "type": "REAL"}]}')

    reply = store.ingest(str(file), "in/costs.csv", "h1", describer).first()
    assert (reply["description"], reply["row_count"], reply["column_count"]) == ("Costs by year", 3, 2)
    row = store.registry.read().first()
    assert row["columns_json"] == '[{"name":"a","type":"INTEGER","description":""},{"name":"b","type":"TEXT","description":"euros"}]'
    card = store.cards.read().first()["text"]
    assert card.startswith("Costs by year") and "1 | 2\n3 | 4\n" in card and "5 | 6" not in card
    broken = store.ingest(str(file), "in/costs.csv", "h2", lambda card: F.lit("Sure, here it is")).first()
    assert broken["description"] == "Table from costs.csv"


def test_answer_tells_what_it_cut(spark, small):
    schemas = spark.createDataFrame([(0, "t1", "in/nation.csv", None, "nation")], "position int, table_id string, source_path string, sheet_name string, table_name string")
    paths = {"nation": f"{small}/nation.parquet"}
    cut = answer(spark, "SELECT n_name FROM nation", schemas, paths, max_rows=3).first()
    assert (cut["row_count"], cut["truncated"], len(cut["rows"])) == (3, True, 3)
    assert [tuple(t) for t in cut["tables"]] == [("t1", "in/nation.csv", None, "nation")]
    whole = answer(spark, "SELECT n_name FROM nation", schemas, paths).first()
    assert (whole["row_count"], whole["truncated"]) == (25, False)
