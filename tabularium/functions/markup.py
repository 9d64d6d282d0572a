"""HTML and plain text to ordered blocks with their heading path."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabularium.functions.arrays import grown
from tabularium.functions.text import SPACE, strip

BLOCK_TYPE = "array<struct<headings:array<string>,text:string,page:int>>"

# Control characters that cannot be part of cleaned text mark the structure.
_BREAK, _LEVEL = "\x01", "\x02"

# Elements whose content is not text.
_SILENT = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>|<head\b[^>]*>.*?</head\s*>"
# Elements that start a new block.
_BLOCK = (
    r"(?i)</?(address|article|aside|blockquote|body|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer"
    r"|form|header|hr|html|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
)
# Code points that numeric references of old pages mean as bytes of a code page, by rule of the standard library.
_ODD_NUMBERS = {n: html.unescape(f"&#{n};") for n in range(0x80, 0xA0)}
# Names of character references, from the standard library; a no-break space is white space like any other.
_NAMED = {name[:-1]: value.replace("\xa0", " ") for name, value in html.entities.html5.items() if name.endswith(";")}
_REFERENCE = r"\A&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);"


def _character(number: Column) -> Column:
    odd = F.try_element_at(F.from_json(F.lit(json.dumps(_ODD_NUMBERS)), "map<string,string>"), number.cast("string"))
    strange = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(strange, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
    return F.when(number == 0xA0, " ").otherwise(F.coalesce(odd, plain))


def unescape(text: Column) -> Column:
    """Named and numeric character references, closed by a semicolon, as characters; others stay."""
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def read(part: Column) -> Column:
        reference = F.regexp_extract(part, _REFERENCE, 1)
        number = F.when(F.lower(F.left(reference, F.lit(2))) == "#x", F.conv(F.substring(reference, 3, 7), 16, 10)).otherwise(F.substring(reference, 2, 8))
        value = F.when(reference.startswith("#"), _character(number.try_cast("int"))).otherwise(F.try_element_at(named, reference))
        return F.when(value.isNull(), part).otherwise(F.concat(value, F.substring(part, F.length(reference) + 3, F.length(part))))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), read), "")).otherwise(text)


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, SPACE, " ")


def html_title(page: Column) -> Column:
    return F.trim(squeeze(unescape(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))))


def _marked(html: Column) -> Column:
    html = F.regexp_replace(F.coalesce(html, F.lit("")), f"[{_BREAK}{_LEVEL}]", " ")
    html = F.regexp_replace(html, _SILENT, " ")
    html = F.regexp_replace(html, r"(?i)<h([1-6])\b[^>]*>", f"{_BREAK}$1{_LEVEL}")
    html = F.regexp_replace(html, r"(?i)</h[1-6]\s*>", _BREAK)
    html = F.regexp_replace(html, _BLOCK, _BREAK)
    return squeeze(unescape(F.regexp_replace(html, r"<[^>]*>", " ")))


def html_blocks(html: Column) -> Column:
    """Blocks of a page. The text is cut in sections at headings; each section
    carries the path of the headings above it, so the fold runs over headings
    and not over blocks."""
    heading = rf"\A([1-6]){_LEVEL}([^{_BREAK}]*)"
    sections = F.split(_marked(html), f"{_BREAK}(?=[1-6]{_LEVEL})")
    parsed = F.transform(
        sections,
        lambda s: F.struct(
            F.regexp_extract(s, heading, 1).try_cast("int").alias("level"),
            F.trim(F.regexp_extract(s, heading, 2)).alias("title"),
            F.array_remove(
                F.transform(F.split(F.regexp_replace(s, heading, ""), _BREAK), lambda b: F.trim(b)), ""
            ).alias("texts"),
        ),
    )
    path_type = "array<struct<level:int,title:string>>"
    placed = F.aggregate(
        parsed,
        F.struct(
            F.array().cast(path_type).alias("path"),
            F.array().cast(f"array<array<struct<path:{path_type},texts:array<string>>>>").alias("full"),
            F.array().cast(f"array<struct<path:{path_type},texts:array<string>>>").alias("done"),
        ),
        _place_section,
        lambda state: F.concat(F.flatten(state["full"]), state["done"]),
    )
    return F.flatten(
        F.transform(
            placed,
            lambda s: F.transform(
                s["texts"],
                lambda text: F.struct(
                    F.transform(s["path"], lambda h: h["title"]).alias("headings"),
                    text.alias("text"),
                    F.lit(None).cast("int").alias("page"),
                ),
            ),
        )
    )


def _place_section(state: Column, section: Column) -> Column:
    above = F.filter(state["path"], lambda h: h["level"] < section["level"])
    here = F.struct(section["level"].alias("level"), section["title"].alias("title"))
    path = (
        F.when(section["level"].isNull(), state["path"])
        .when(section["title"] == "", above)
        .otherwise(F.concat(above, F.array(here)))
    )
    full, done = grown(state["full"], state["done"], F.struct(path.alias("path"), section["texts"].alias("texts")))
    return F.struct(path.alias("path"), full.alias("full"), done.alias("done"))


def text_blocks(text: Column) -> Column:
    """Non-empty lines of plain text; a form feed starts a new page."""
    no_headings = F.array().cast("array<string>")
    pages = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\f"),
        lambda page, number: F.transform(
            F.array_remove(F.transform(F.split(page, "\n"), strip), ""),
            lambda line: F.struct(
                no_headings.alias("headings"), line.alias("text"), (number + 1).cast("int").alias("page")
            ),
        ),
    )
    return F.flatten(pages)
