"""Payload maps of collection points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The payload key that holds the text itself.
TEXT_KEY = "text"


def without_text(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda key, _: key != TEXT_KEY)


def payload(text: Column, metadata: Column) -> Column:
    """JSON of the text and its metadata; a metadata key ``text`` is ignored."""
    extra = F.coalesce(without_text(metadata), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.create_map(F.lit(TEXT_KEY), text), extra))


def point_id(given: Column, *parts: Column) -> Column:
    """The given id, or a stable one derived from ``parts``, shaped like a UUID.

    A task that is run again derives the same id, which a random one would not.
    """
    digest = F.md5(F.concat_ws("\x1f", *parts))
    shaped = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.coalesce(given, shaped)


def matches(payload_json: Column, **wanted: str) -> Column:
    """All payload keys equal the wanted values; a missing key never does."""
    condition = F.lit(True)
    for key, value in wanted.items():
        condition = condition & F.coalesce(F.get_json_object(payload_json, f"$.{key}") == F.lit(value), F.lit(False))
    return condition
