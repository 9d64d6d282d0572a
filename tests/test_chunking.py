from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tabularium.functions.markup import html_blocks, html_title, text_blocks
from tabularium.operators.chunking import chunk, export_documents
from tabularium.sources.documents import parse_documents, read_files

PAGE = """<!doctype html><html><head><title>A &amp; B</title><style>p{}</style></head><body>
<script>var t="</p><h1>no</h1>";</script><!-- <p>hidden</p> -->
<p>before</p><h1>One</h1><p>first &lt;b&gt;</p><h2>Two</h2><ul><li>item 1<li>item 2</ul>
<h3></h3><p>under  two</p><h2>Three</h2><table><tr><td>c1</td><td>c2</td></tr></table><h1>Four</h1>text <b>bold</b><br>end</body></html>"""


def blocks_of(spark, sizes, headings=None):
    headings = headings or [[] for _ in sizes]
    rows = [("doc/a.txt", [(h, " ".join(["w"] * n), 1 + i // 2) for i, (n, h) in enumerate(zip(sizes, headings, strict=True))])]
    return spark.createDataFrame(rows, "path string, blocks array<struct<headings:array<string>,text:string,page:int>>")


def sizes(frame):
    return [r["num_tokens"] for r in frame.orderBy("chunk_index").collect()]


@pytest.mark.parametrize(
    ("given", "expected"),
    [([3, 4, 2, 6, 1], [7, 2, 7]), ([7, 7], [7, 7]), ([8], [7, 1]), ([20], [7, 7, 6]), ([1, 9, 1], [1, 7, 3])],
)
def test_packing(spark, given, expected):
    assert sizes(chunk(blocks_of(spark, given), 7)) == expected


def test_headings_open_a_chunk(spark):
    frame = chunk(blocks_of(spark, [2, 2, 2], [["A"], ["A", "B"], ["A", "B"]]), 100, include_raw_text=True)
    rows = frame.orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["A\nw w", "A\nB\nw w\nw w"]
    assert [r["raw_text"] for r in rows] == ["w w", "w w\nw w"]
    assert [r["headings"] for r in rows] == [["A"], ["A", "B"]]
    assert [r["page_numbers"] for r in rows] == [[1], [1, 2]]
    assert rows[1]["doc_items"] == ["#/texts/1", "#/texts/2"] and rows[0]["filename"] == "a.txt"


def test_sentences_are_cut_before_words(spark):
    rows = [("d", [([], "One two. Three four five! Six", None)])]
    frame = spark.createDataFrame(rows, "path string, blocks array<struct<headings:array<string>,text:string,page:int>>")
    texts = [r["text"] for r in chunk(frame, 3).orderBy("chunk_index").collect()]
    assert texts == ["One two.", "Three four five!", "Six"]


def test_nulls_and_empty(spark):
    frame = spark.createDataFrame([("a", ""), ("b", None), ("c", " \n x \f y")], "path string, text string")
    rows = chunk(frame.withColumn("blocks", text_blocks(F.col("text")))).collect()
    assert [(r["path"], r["text"], r["page_numbers"]) for r in rows] == [("c", "x\ny", [1, 2])]
    assert rows[0]["raw_text"] is None and rows[0]["headings"] is None and rows[0]["captions"] is None


def test_html(spark):
    frame = spark.createDataFrame([(PAGE,)], "html string")
    blocks = frame.select(html_blocks(F.col("html")).alias("b"), html_title(F.col("html")).alias("t")).first()
    assert blocks["t"] == "A & B"
    assert [(b["headings"], b["text"]) for b in blocks["b"]] == [
        ([], "before"), (["One"], "first <b>"), (["One", "Two"], "item 1"), (["One", "Two"], "item 2"),
        (["One", "Two"], "under two"), (["One", "Three"], "c1"), (["One", "Three"], "c2"),
        (["Four"], "text bold end"),
    ]


def test_chunks_hold_every_word_in_order(spark):
    rng = random.Random(5)
    words = ["a.", "b", "c!", "d", "ee?", "f"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    blocks = frame.select(F.col("n").cast("string").alias("path"), text_blocks(F.col("text")).alias("blocks"))
    for budget in (1, 5, 64):
        rows = chunk(blocks, budget).collect()
        assert all(0 < r["num_tokens"] <= budget for r in rows)
        for n, text in enumerate(texts):
            own = sorted((r for r in rows if r["path"] == str(n)), key=lambda r: r["chunk_index"])
            assert [r["chunk_index"] for r in own] == list(range(len(own)))
            assert " ".join(r["text"] for r in own).split() == text.split()


def test_export(spark):
    row = export_documents(blocks_of(spark, [2])).first()
    assert (row["kind"], row["status"], row["errors"], row["timings"]) == ("ExportResult", "success", [], {})
    assert row["content"]["filename"] == "a.txt" and '"text":"w w"' in row["content"]["json_content"]


def test_files_and_parser_plug_in(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    (tmp_path / "b.HTML").write_text("<h1>T</h1><p>z</p>")
    (tmp_path / "c.bin").write_bytes(b"good")
    (tmp_path / "d.bin").write_bytes(b"bad")
    files = read_files(spark, str(tmp_path))

    def parser(content, path):
        if content == b"bad":
            raise ValueError("broken")
        return [([], content.decode(), 3)]

    rows = {r["path"].rsplit("/", 1)[1]: r for r in parse_documents(files, parser).collect()}
    assert [b["text"] for b in rows["a.txt"]["blocks"]] == ["x", "y"]
    assert rows["b.HTML"]["blocks"][0]["headings"] == ["T"]
    assert rows["c.bin"]["blocks"][0]["page"] == 3 and rows["c.bin"]["errors"] == []
    assert rows["d.bin"]["errors"][0]["error_message"] == "broken" and rows["d.bin"]["blocks"] == []
    failed = export_documents(parse_documents(files, parser)).filter("status = 'failure'").collect()
    assert len(failed) == 1
    assert rows["a.txt"]["file_hash"] == __import__("hashlib").md5(b"x\ny").hexdigest()


def test_character_references(spark):
    page = "<p>Gr&ouml;&szlig;e &#8217; &#x41;&#X42; &euro; &nope; &amp;lt; &#0; &#128; &#1114112; a&nbsp;b & c &lt;p&gt; &#55296;</p>"
    blocks = spark.createDataFrame([(page,)], "html string").select(html_blocks(F.col("html")).alias("b")).first()["b"]
    assert [b["text"] for b in blocks] == ["Größe ’ AB € &nope; &lt; \ufffd € \ufffd a b & c <p> \ufffd"]


def test_long_documents_take_time_in_proportion(spark):
    def seconds(lines):
        text = "\n".join(f"line {i} of the text with some words in it." for i in range(lines))
        rows = spark.createDataFrame([("p", text)], "path string, text string").select("path", text_blocks(F.col("text")).alias("blocks"))
        start = time.perf_counter()
        assert chunk(rows, 24).agg(F.sum("num_tokens")).first()[0] >= 9 * lines
        return time.perf_counter() - start

    seconds(1000)
    short, long = seconds(8000), seconds(64000)
    assert long < 24 * max(short, 0.25)
