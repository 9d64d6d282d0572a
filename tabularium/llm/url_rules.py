"""URL filter: a sort-merge range join of URLs with nested host and path rules.

A host is turned round into a key of its labels from the top-level domain
down, each closed by a separator. A rule's host then is an interval of keys: all
keys that start with its own. URLs and rules are sorted by key in one stream;
a sweep keeps a stack of the rules whose intervals are open, innermost last.

The key space is cut into cells of about equal numbers of URLs, by a sample that
decides the cuts only. A URL goes to one cell, a rule to every cell its interval
meets, so a cell's stack is complete; cuts also run through the URLs of a single
host, so a hot host is shared by many cells.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.registry import ascii_lower, contract, read

# Closes each host label; sorts below every character of a host.
_SEPARATOR = "\x01"
_LAST = "\U0010ffff"

# Rows of the sample that fixes the cuts, for each cell.
SAMPLE_PER_CELL = 32

_OUT = "id {id}, host string, path string, rule string, verdict string"


def host_path(url):
    """Host and path of a URL column; both empty for null or without ``://``."""
    host = ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host):
    """``a.example.net`` as ``net|example|a|``, with the separator as bar."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _SEPARATOR), F.lit(_SEPARATOR))


class _Level:
    """Open rules of one host, their paths sorted; ``above`` is the next shorter path that a path starts with."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.above: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.above[at]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.above.append(at)

    def longest(self, path: str) -> int:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.above[at]
        return at


def _sweep(default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[_Level] = []
        cell = None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if row.cell != cell:
                    stack, cell = [], row.cell
                while stack and not row.key.startswith(stack[-1].key):
                    stack.pop()
                if row.is_rule:
                    if not stack or stack[-1].key != row.key:
                        stack.append(_Level(row.key, row.host))
                    stack[-1].add(row.path, row.verdict)
                    continue
                best = None
                for level in stack:
                    if row.host != level.host and not row.host.endswith("." + level.host):
                        continue
                    at = level.longest(row.path)
                    if at >= 0:
                        size = (len(level.host) + len(level.paths[at]), len(level.host))
                        if best is None or size > best[0]:
                            best = (size, level.host + level.paths[at], level.verdicts[at])
                found.append((row.id, row.host, row.path, *(best[1:] if best else (None, default))))
            yield pd.DataFrame(found, columns=["id", "host", "path", "rule", "verdict"]).astype({"id": batch["id"].dtype})

    return run


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """``id, host, path, rule, verdict``: one row per page, whatever its URL.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all
    subdomains if the URL's path starts with the rule's; of several the one with
    the longest host and path together wins, then the one with the longest host;
    of equal rules with two verdicts the alphabetically last (``block``). A URL
    that no rule fits gets ``default`` and a null rule. Null URLs and texts
    without ``://`` have an empty host and path. Repeated pages give repeated
    rows; other columns are not looked at; empty tables give empty results, and
    rules with a null in host or path fit nothing.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    urls = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_key(F.col("host")))
    place = F.concat("key", "path", F.lit("\x00"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    urls = urls.withColumn("place", place)
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = urls.select("place", F.xxhash64("place").alias("draw")).orderBy("draw", "place").limit(SAMPLE_PER_CELL * cells)
    drawn = sorted(row["place"] for row in sample.collect())
    cuts = sorted(set(drawn[SAMPLE_PER_CELL::SAMPLE_PER_CELL]))

    @F.pandas_udf("long")
    def cell_of(places: pd.Series) -> pd.Series:
        return places.map(lambda x: bisect_right(cuts, x)).astype("int64")

    # The nested rules of one host and path are one rule: a stack holds no duplicates.
    known = (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", reversed_key(F.col("host")))
    )
    first, last = cell_of(F.col("key")), cell_of(F.concat("key", F.lit(_LAST)))
    known = known.withColumn("cell", F.explode(F.sequence(first, last)))
    kind = dict(urls.dtypes)["id"]
    events = urls.select(
        cell_of(F.col("place")).alias("cell"), "key", F.lit(False).alias("is_rule"), "path", "host", "id", F.lit(None).cast("string").alias("verdict")
    ).unionByName(known.select("cell", "key", F.lit(True).alias("is_rule"), "path", "host", F.lit(None).cast(kind).alias("id"), "verdict"))
    swept = (
        events.repartition(cells, "cell")
        .sortWithinPartitions("cell", "key", F.col("is_rule").desc(), "path")
        .mapInPandas(_sweep(default), _OUT.format(id=kind))
    )
    return swept.withColumnRenamed("id", id_column)


# The rules of the query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_BY_LENGTH = sorted(RULES, key=lambda rule: -len(rule[0] + rule[1]))
_SQL = f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} ELSE 'allow' END AS verdict
FROM parts
"""


@contract("op2_url_rules", _SQL)
def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(read(spark, folder, "pages"), rules)
