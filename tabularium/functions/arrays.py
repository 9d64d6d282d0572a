"""Exploding computed arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, array: Column, value: str, position: str | None = None) -> DataFrame:
    """Add one row per element.

    An inner explode makes Catalyst infer ``size(array) > 0`` below it and so
    compute a costly array a second time. The outer form does not; rows it adds
    for empty arrays are dropped by position.
    """
    place = position or "_place"
    kept = df.select("*", F.posexplode_outer(array).alias(place, value)).filter(F.col(place).isNotNull())
    return kept if position else kept.drop(place)


# Bytes of text that a kernel takes at once: its arrays beside a batch are several times as large.
TEXT_AT_ONCE = 1 << 21


def by_pieces(values: pa.Array, kernel: Callable[[pa.Array], pa.Array], most: int = TEXT_AT_ONCE) -> pa.Array:
    """A kernel that works row by row, on some rows at a time: about ``most`` bytes of texts or elements of lists."""
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, done = [], 0
    while not parts or done < len(values):
        before = ends[done - 1] if done else 0
        take = max(1, int(np.searchsorted(ends, before + most, side="right")) - done)
        parts.append(kernel(values.slice(done, take)))
        done += take
    whole = pa.concat_arrays(parts)
    del parts
    # A worker waits for the next task with what its pool keeps.
    pa.default_memory_pool().release_unused()
    return whole


def split_texts(texts: pa.Array) -> pa.Array:
    """Bags of the tokens of ``token_text``; an empty text has none."""
    parts = pc.split_pattern(texts, " ")
    values = parts.flatten()
    sizes = pc.if_else(pc.equal(texts, ""), 0, pc.list_value_length(parts))
    ends = pc.cumulative_sum(sizes.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, values.filter(pc.not_equal(values, "")))


# Elements gathered before they move on as one.
_RUN = 256


def grown(full: Column, run: Column, element: Column) -> tuple[Column, Column]:
    """A list under construction inside a fold, with one more element.

    Appending copies a list, so a fold that appends to one list is quadratic. Here
    a short run is appended to, and joins the list of full runs as a whole.
    """
    over = F.size(run) >= _RUN
    return F.when(over, F.concat(full, F.array(run))).otherwise(full), F.when(over, F.array(element)).otherwise(F.concat(run, F.array(element)))
