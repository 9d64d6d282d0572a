"""Workbook files as long rows, through a pluggable sheet reader."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# bytes -> (sheet name, rows of cells) pairs
SheetReader = Callable[[bytes], Iterable[tuple[str, Iterable[list]]]]

CELLS = "path string, sheet string, row_no int, cells array<string>, error string"


def workbook_rows(files: DataFrame, reader: SheetReader, batch_rows: int = 10_000) -> DataFrame:
    """``path, sheet, row_no, cells, error`` for ``files(path, content)``.

    Row 0 is the header. Rows leave the task in batches; a file that cannot be
    read gives one row with the error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    for sheet, lines in reader(content.as_py()):
                        for number, line in enumerate(lines):
                            cells = [None if cell is None else str(cell) for cell in line]
                            rows.append((path, sheet, number, cells, None))
                            if len(rows) >= batch_rows:
                                yield _to_batch(rows)
                                rows = []
                except Exception as error:  # noqa: BLE001 - an unreadable file is a record, not a job failure
                    rows.append((path, None, None, None, str(error)))
                if rows:
                    yield _to_batch(rows)

    return files.select("path", "content").mapInArrow(read, CELLS)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "sheet", "row_no", "cells", "error"])


def sheet_headers(rows: DataFrame) -> DataFrame:
    """``path, sheet, headers``; a missing header cell becomes ``col_<position>``."""
    names = F.transform("cells", lambda h, i: F.coalesce(h, F.concat(F.lit("col_"), i.cast("string"))))
    return rows.filter(F.col("row_no") == 0).select("path", "sheet", names.alias("headers"))


def sheet_cells(rows: DataFrame, position: int) -> Column:
    """One column of a sheet's data rows; short rows give null."""
    return F.get("cells", F.lit(position))
