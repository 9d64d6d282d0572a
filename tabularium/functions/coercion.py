"""Typing and coercion of text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabularium.functions.text import NULL_TOKENS, strip

# Column labels and the types they are stored as.
TYPE_LABELS = {
    "TEXT": "string",
    "INTEGER": "bigint",
    "REAL": "double",
    "DATE": "date",
    "BOOLEAN": "boolean",
    "NUMERIC": "double",
}
# Cells that read as true.
TRUE_WORDS = ("true", "1", "yes", "ja")
# Cells that let a whole column be taken for BOOLEAN.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "ja", "nein")
# Opt-in magnitude suffixes.
MAGNITUDES = {"K": 1e3, "M": 1e6, "B": 1e9}

DECIMAL_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
WHOLE_NUMBER = r"^[+-]?\d+\z"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"


def stored_type(label: Column) -> Column:
    """Stored type of a label; unknown labels are text."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(strip(label))), F.lit("string"))


def _number(cell: Column, magnitude_suffix: bool) -> Column:
    plain = F.when(cell.rlike(DECIMAL_NUMBER), cell.try_cast("double"))
    if not magnitude_suffix:
        return plain
    factor = F.lit(None).cast("double")
    for suffix, value in MAGNITUDES.items():
        factor = F.when(F.upper(F.right(cell, F.lit(1))) == suffix, F.lit(value)).otherwise(factor)
    head = F.regexp_replace(cell, r"[KkMmBb]\z", "")
    return F.coalesce(plain, F.when(head.rlike(DECIMAL_NUMBER), head.try_cast("double") * factor))


def clean_cell(cell: Column) -> Column:
    """The stripped cell, null when it reads as missing."""
    stripped = strip(cell)
    return F.when(~F.lower(stripped).isin(*NULL_TOKENS), stripped)


def coerce(cell: Column, label: str, magnitude_suffix: bool = False) -> Column:
    """The cell as a value of the label's type; null when it does not fit."""
    return coerce_clean(clean_cell(cell), cell, label, magnitude_suffix)


def coerce_clean(clean: Column, cell: Column, label: str, magnitude_suffix: bool = False) -> Column:
    """The same for a cell already cleaned; text keeps its outer white space.

    Whole numbers keep all their digits, other numbers truncate toward zero.
    """
    kind = TYPE_LABELS.get(label.strip().upper(), "string")
    if kind == "bigint":
        return F.coalesce(
            F.when(clean.rlike(WHOLE_NUMBER), clean.try_cast("bigint")),
            _number(clean, magnitude_suffix).try_cast("bigint"),
        )
    if kind == "double":
        return _number(clean, magnitude_suffix)
    if kind == "boolean":
        return F.lower(clean).isin(*TRUE_WORDS)
    if kind == "date":
        return F.when(clean.rlike(ISO_DATE), F.try_to_date(clean, "yyyy-MM-dd"))
    return F.when(clean.isNotNull(), cell)


def rescued(cells: dict[str, tuple[Column, Column, Column]]) -> Column:
    """``column -> original text`` for cells that hold something their type
    cannot: a map, null when every cell fits. Row counts never change.

    ``cells`` maps a column to its original, cleaned and typed form.
    """
    entries = [
        F.when(clean.isNotNull() & typed.isNull(), F.struct(F.lit(name).alias("key"), raw.alias("value")))
        for name, (raw, clean, typed) in cells.items()
    ]
    kept = F.map_from_entries(F.filter(F.array(*entries), F.isnotnull))
    return F.when(F.size(kept) > 0, kept)


def type_evidence(clean: Column) -> list[Column]:
    """Counts over a cleaned column: filled cells and how many fit each type."""
    return [
        F.count(clean).alias("filled"),
        F.count_if(F.lower(clean).isin(*BOOLEAN_WORDS)).alias("booleans"),
        F.count_if(clean.rlike(WHOLE_NUMBER) & clean.try_cast("bigint").isNotNull()).alias("integers"),
        F.count_if(_number(clean, False).isNotNull()).alias("reals"),
        F.count_if(clean.rlike(ISO_DATE) & F.try_to_date(clean, "yyyy-MM-dd").isNotNull()).alias("dates"),
    ]


def type_from_evidence(evidence: Column) -> Column:
    """First type that every filled cell fits; text if none or nothing is filled."""
    filled = evidence["filled"]
    return (
        F.when(filled == 0, "TEXT")
        .when(evidence["booleans"] == filled, "BOOLEAN")
        .when(evidence["integers"] == filled, "INTEGER")
        .when(evidence["reals"] == filled, "REAL")
        .when(evidence["dates"] == filled, "DATE")
        .otherwise("TEXT")
    )
