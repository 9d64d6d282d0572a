"""CSV and TSV files as text columns and as typed, registered tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.text import file_extension, identifier

# Extensions and what reads them.
DELIMITERS = {".csv": ",", ".tsv": "\t"}
WORKBOOKS = (".xlsx", ".xls", ".ods")


def dispatch(path: Column) -> Column:
    """Reader for a file: ``delimited``, ``workbook`` or null when unsupported."""
    extension = file_extension(path)
    return F.when(extension.isin(*DELIMITERS), "delimited").when(extension.isin(*WORKBOOKS), "workbook")


def unsupported(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files no reader takes, as failure records ``path, error``."""
    message = F.concat(F.lit("Unsupported table file format: "), file_extension(F.col(path_col)))
    return files.filter(dispatch(F.col(path_col)).isNull()).select(F.col(path_col).alias("path"), message.alias("error"))


def header_names(headers: Column) -> Column:
    """Safe, distinct column names for a header record, ``array<string>``.

    Missing headers become ``col_<position>``, repeated ones get ``_2``, ``_3``.
    """
    plain = F.transform(headers, lambda h, i: identifier(F.coalesce(h, F.concat(F.lit("col_"), i.cast("string"))), "col"))

    def added(names: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(names) + 1), lambda n: F.when(n == 1, name).otherwise(F.concat_ws("_", name, n.cast("string"))))
        return F.concat(names, F.array(F.filter(tries, lambda one: ~F.array_contains(names, one))[0]))

    return F.aggregate(plain, F.array().cast("array<string>"), added)


def column_names(spark: SparkSession, headers: list[str | None]) -> list[str]:
    """The names of one header record, on the driver."""
    one = spark.createDataFrame([(headers,)], "headers array<string>")
    return list(one.select(header_names(F.col("headers"))).first()[0])


def cells_of(record: str, delimiter: str) -> list[str | None]:
    """The cells of one record; empty ones are None, a blank record has none."""
    record = record.removesuffix("\r")
    if '"' not in record:
        return [cell or None for cell in record.split(delimiter)] if record else []
    cells, held, odd = [], [], 0
    for piece in record.split(delimiter):
        held.append(piece)
        odd ^= piece.count('"') & 1
        if not odd:
            cell = delimiter.join(held)
            if len(cell) > 1 and cell[0] == cell[-1] == '"':
                cell = cell[1:-1].replace('""', '"')
            cells.append(cell or None)
            held = []
    if held:
        # A quote that never ends takes the rest.
        cells.append(delimiter.join(held).removeprefix('"') or None)
    return cells


def _quoting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``odd, file, split`` to one row per split: whether its quotes are odd, and whether a line in it ends a cell that was open before the split."""
    place, parity, closes = None, 0, False
    for batch in batches:
        odd = batch.column(0).to_numpy(zero_copy_only=False)
        for at, a, b in _runs(batch.column(1), batch.column(2)):
            if at != place:
                if place:
                    yield _quoting_batch(place, parity, closes)
                place, parity, closes = at, 0, False
            ends = np.cumsum(odd[a:b]) + parity & 1
            parity, closes = int(ends[-1]), closes or bool(ends.any())
    if place:
        yield _quoting_batch(place, parity, closes)


def _quoting_batch(place: tuple[str, int], parity: int, closes: bool) -> pa.RecordBatch:
    columns = [pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([parity], pa.int32()), pa.array([closes])]
    return pa.RecordBatch.from_arrays(columns, ["file", "split", "odd", "closes"])


def _runs(files: pa.Array, splits: pa.Array) -> list[tuple[tuple[str, int], int, int]]:
    """File and split of neighbouring lines that share them, with the first line and the one after the last."""
    starts, codes = splits.to_numpy(), files.dictionary_encode().indices.to_numpy()
    if not len(starts):
        return []
    runs = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 0) | (np.diff(codes) != 0)))).tolist()
    return [((files[a].as_py(), int(starts[a])), a, b) for a, b in zip(runs, [*runs[1:], len(starts)], strict=True)]


# Of a file's splits, rising: where each starts, whether it begins inside a quoted cell, and the split in which that cell's record begins.
Splits = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _splits(lines: DataFrame) -> Splits:
    """What the splits of each file begin with: three numbers per split, as the driver's list of tasks has some.

    Quotes come in pairs in whole cells, so the parity of all quotes before tells.
    """
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    quoting = lines.select(odd.alias("odd"), "file", "split").mapInArrow(_quoting, "file string, split long, odd int, closes boolean")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    told = quoting.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    # A record that goes on into the next split begins here, unless it has been open all the way.
    opens = (F.col("inside") != (F.col("odd") == 1)) & (~F.col("inside") | F.col("closes"))
    told = told.withColumn("opener", F.last(F.when(opens, F.col("split")), ignorenulls=True).over(before))
    place = F.struct("split", "inside", F.coalesce("opener", F.lit(-1)).alias("opener"))
    files = told.groupBy("file").agg(F.array_sort(F.collect_list(place)).alias("places")).toArrow()
    found = {}
    for file, places in zip(files["file"].to_pylist(), files["places"], strict=True):
        found[file] = tuple(places.values.field(name).to_numpy(zero_copy_only=False) for name in ("split", "inside", "opener"))
    return found


_RECORDS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("number", pa.int64()), ("cells", pa.list_(pa.string()))])
_PARTS = pa.schema([("file", pa.string()), ("record", pa.int64()), ("split", pa.int64()), ("opens", pa.bool_()), ("number", pa.int64()), ("part", pa.string())])


def _cutter(told: Broadcast, delimiter: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines to the ``whole`` records of their splits, or to the parts of those that reach over the ends of a split."""
    schema = _RECORDS if whole else _PARTS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pending, number, is_open, tail, opener = None, [], 0, False, False, -1
        rows: list[tuple] = []

        def close() -> None:
            if pending and not whole:
                rows.append((place[0], opener if tail else place[1], place[1], not tail, number, "\n".join(pending)))

        for batch in batches:
            values = batch.column(0)
            odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
            for at, a, b in _runs(batch.column(1), batch.column(2)):
                lines = values.slice(a, b - a).to_pylist()
                if at != place:
                    close()
                    starts, inside, openers = told.value.get(at[0], (np.zeros(0),) * 3)
                    i = int(np.searchsorted(starts, at[1]))
                    if i == len(starts) or starts[i] != at[1]:
                        raise RuntimeError("the splits of the files have changed between two passes; read them again")
                    place, pending, number, is_open, opener = at, [], 0, bool(inside[i]), int(openers[i])
                    tail = is_open
                    if at[1] == 0:
                        lines[0] = lines[0].removeprefix("\ufeff")
                # A record ends with the line after which all quotes are closed.
                parity = np.cumsum(odd[a:b]) + is_open & 1
                done = 0
                for end in (np.flatnonzero(parity == 0) + 1).tolist():
                    record = "\n".join([*pending, *lines[done:end]])
                    pending, done = [], end
                    if tail:
                        if not whole:
                            rows.append((place[0], opener, place[1], False, number, record))
                        tail = False
                    elif not whole:
                        number += bool(record.removesuffix("\r"))
                    elif cells := cells_of(record, delimiter):
                        rows.append((*place, number, cells))
                        number += 1
                pending += lines[done:]
                is_open = bool(parity[-1])
            if rows:
                yield _batch_of(rows, schema)
                rows.clear()
        close()
        if rows:
            yield _batch_of(rows, schema)

    return cut


def _batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _joined(parts: DataFrame, delimiter: str) -> DataFrame:
    """Records put together from their parts in following splits; the parts of one record are one value."""
    whole = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "opens", "number", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")

    @F.arrow_udf("array<string>")
    def cells(texts: pa.Array) -> pa.Array:
        return pa.array([cells_of(t, delimiter) for t in texts.to_pylist()], pa.list_(pa.string()))

    return whole.select("file", F.col("parts")[0]["split"].alias("split"), F.col("parts")[0]["number"].alias("number"), cells(text).alias("cells"))


def read_records(spark: SparkSession, paths: str | list[str], delimiter: str = ",") -> DataFrame:
    """``file, split, number, cells`` of all records of delimited files, header records included; blank lines are left out.

    ``split, number`` order the records of a file. Files are read in splits, also
    where cells hold line breaks: a first pass counts the quotes of each split, which
    tells the next one whether it begins inside a cell, and records that reach over
    the end of a split are put together from their parts. Quotes inside cells must be
    doubled, and cells with quotes quoted.
    """
    return records_and_files(spark, paths, delimiter)[0]


def records_and_files(spark: SparkSession, paths: str | list[str], delimiter: str = ",") -> tuple[DataFrame, list[str]]:
    """``read_records``, and the files that have any line, which the first pass has told the driver."""
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    splits = _splits(lines)
    told = spark.sparkContext.broadcast(splits)
    records = lines.mapInArrow(_cutter(told, delimiter, True), "file string, split long, number long, cells array<string>")
    if any(inside.any() for _, inside, _ in splits.values()):
        shape = "file string, record long, split long, opens boolean, number long, part string"
        records = records.unionByName(_joined(lines.mapInArrow(_cutter(told, delimiter, False), shape), delimiter))
    return records, sorted(splits)


def is_header() -> Column:
    """The first record of each file."""
    return (F.col("split") == 0) & (F.col("number") == 0)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame | None:
    """A delimited file, or a folder of parts with one header each, as text columns.

    Short rows are padded with null, long ones cut, blank lines dropped. A file
    without a single line gives ``None``.
    """
    # Of this read no more than the first record is fetched.
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "header": "false", "inferSchema": "false"}
    first = spark.read.options(**options).csv(path).limit(1).collect()
    if not first:
        return None
    names = column_names(spark, [h.removeprefix("\ufeff") if h is not None else None for h in first[0]])
    records = read_records(spark, path, delimiter)
    return records.filter(~is_header()).select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)])
