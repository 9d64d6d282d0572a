"""Tables upserted by key on plain Parquet folders.

A table is a full base plus the batches that came after it. An upsert writes
only its own rows and the keys they replace, so its cost follows the batch and
not the table. Reading drops replaced rows with an anti join on each kind of key
that was used, which is a broadcast as long as they are few; ``compact`` folds the batches
into a new base, after which reading is a plain scan.

A batch counts once its list of replaced keys is committed, a base once its own
job is. Nothing that may be read is ever overwritten, so a job that dies, or is
run again, does no harm. A table has one writer at a time. Where the catalog offers row-level operations, its
``MERGE`` does the same and this module is not needed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.operators.ranking import latest
from tabularium.session import shared_path
from tabularium.sources.files import delete, is_committed, list_names

_BATCH = "_batch"
# Rows are written by an upsert and again by each compaction, and points hold their text twice.
_CODEC = "zstd"
# Bytes of a row group as written: a task that writes or reads holds a whole one, compressed and in part unpacked.
_ROW_GROUP = 16 << 20


def write_rows(rows: DataFrame, root: str) -> None:
    """Write a folder of Parquet, or write it again where a job died."""
    rows.write.mode("overwrite").option("parquet.block.size", _ROW_GROUP).parquet(root, compression=_CODEC)


class KeyedTable:
    """Rows below ``root`` with the columns of ``schema``, given as DDL.

    ``keys`` are the columns rows may be replaced by, the first being unique.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), tuple(keys)
        self.schema = T.StructType.fromDDL(schema)

    def _committed(self, folder: str, prefix: str) -> list[int]:
        names = [n for n in list_names(self.spark, folder) if re.fullmatch(prefix + r"\d+", n)]
        return sorted(int(n[len(prefix) :]) for n in names if is_committed(self.spark, f"{folder}/{n}"))

    def _bases(self) -> list[int]:
        return self._committed(self.root, "base-")

    def _batches(self, base: int) -> list[int]:
        return self._committed(f"{self.root}/after-{base}/replaced", "batch-")

    def state(self) -> str:
        """Name of the current content; it changes with every batch and base."""
        base = self._bases()[-1]
        return f"{base}-{max(self._batches(base), default=0)}"

    def create(self) -> KeyedTable:
        """Write an empty base unless there is one; an old one must have the columns."""
        bases = self._bases()
        if not bases:
            self._write_base(self.spark.createDataFrame([], self.schema), 1)
        else:
            found = self.spark.read.parquet(f"{self.root}/base-{bases[-1]}").columns
            missing = set(self.schema.names) - set(found)
            if missing:
                raise ValueError(f"{self.root} lacks the columns {sorted(missing)}")
        return self

    def _write_base(self, rows: DataFrame, number: int) -> None:
        stamped = rows.select(*self.schema.names, F.lit(0).alias(_BATCH))
        write_rows(stamped, f"{self.root}/base-{number}")

    def read(self) -> DataFrame:
        """The live rows. Nothing can have replaced those of the newest batch, so they are only scanned."""
        return self._live()

    def _live(self, scratch: str | None = None) -> DataFrame:
        """The live rows; with a folder for it, keys that meet no row are sorted out first."""
        bases = self._bases()
        if not bases:
            raise FileNotFoundError(f"no table below {self.root}")
        base = bases[-1]
        batches = self._batches(base)
        after = f"{self.root}/after-{base}"
        stored = T.StructType([*self.schema.fields, T.StructField(_BATCH, T.IntegerType())])

        def scan(*folders: str) -> DataFrame:
            return self.spark.read.schema(stored).parquet(*folders)

        rows = scan(f"{self.root}/base-{base}", *[f"{after}/rows/batch-{n}" for n in batches[:-1]])
        if batches:
            replaced = self.spark.read.schema(f"key string, value string, {_BATCH} int").parquet(
                *[f"{after}/replaced/batch-{n}" for n in batches]
            )
            for key in self._used(replaced):
                last = (
                    replaced.filter(F.col("key") == key)
                    .groupBy(F.col("value").alias("_value"))
                    .agg(F.max(_BATCH).alias("_last"))
                )
                dead = (F.col(key).cast("string") == F.col("_value")) & (F.col(_BATCH) < F.col("_last"))
                if scratch:
                    met = rows.select(key, _BATCH).join(last, dead).select("_value", "_last").distinct()
                    write_rows(met, f"{scratch}/{key}")
                    last = self.spark.read.schema("_value string, _last int").parquet(f"{scratch}/{key}")
                rows = rows.join(last, dead, "left_anti")
            rows = rows.unionByName(scan(f"{after}/rows/batch-{batches[-1]}"))
        return rows.select(*self.schema.names)

    def _used(self, replaced: DataFrame) -> list[str]:
        """The keys by which rows were replaced: an anti join on another would deal out the whole table for nothing."""
        if len(self.keys) == 1:
            return list(self.keys)
        found = {row["key"] for row in replaced.select("key").distinct().collect()}
        return [key for key in self.keys if key in found]

    def upsert(
        self,
        rows: DataFrame,
        order: Sequence[Column] | None = None,
        key: str | None = None,
        replaced: DataFrame | None = None,
    ) -> int:
        """Add a batch; old rows with the same key go. Returns its number.

        Of several rows with one key the first by ``order`` is kept; without an
        order they must be unique already. ``replaced`` (one column) names other
        keys whose old rows go as well, e.g. files that shrank or disappeared.
        """
        key = key or self.keys[0]
        if order:
            rows = latest(rows, [self.keys[0]], order)
        base = self._bases()[-1]
        number = max(self._batches(base), default=0) + 1
        after = f"{self.root}/after-{base}"
        write_rows(rows.select(*self.schema.names, F.lit(number).alias(_BATCH)), f"{after}/rows/batch-{number}")
        # Keys come from the written rows: the batch is computed once.
        gone = self.batch(number).select(F.col(key).cast("string").alias("value"))
        if replaced is not None:
            gone = gone.unionByName(replaced.select(F.col(replaced.columns[0]).cast("string").alias("value")))
        if replaced is not None or key != self.keys[0]:
            gone = gone.distinct()
        gone.select(F.lit(key).alias("key"), "value", F.lit(number).alias(_BATCH)).write.mode("overwrite").parquet(
            f"{after}/replaced/batch-{number}"
        )
        return number

    def batch(self, number: int) -> DataFrame:
        """The rows one batch brought, without looking at the rest of the table."""
        return self.spark.read.schema(self.schema).parquet(
            f"{self.root}/after-{self._bases()[-1]}/rows/batch-{number}"
        )

    def delete(self, key: str, values: DataFrame) -> int:
        """Drop the rows whose ``key`` is among ``values`` (one column)."""
        return self.upsert(self.spark.createDataFrame([], self.schema), key=key, replaced=values)

    def compact(self) -> int:
        """Write the live rows as a new base; returns its number.

        Which keys were replaced at all is found out from the keys alone. Mostly they
        are few, however many were brought, and then no row is shuffled.
        """
        number = self._bases()[-1] + 1
        scratch = shared_path(self.spark, "replaced")
        self._write_base(self._live(scratch), number)
        delete(self.spark, scratch)
        return number

    def is_compact(self) -> bool:
        """Whether storage holds one base and nothing else."""
        bases = self._bases()
        return len(bases) == 1 and not self._batches(bases[0])

    def forget(self, keep: int = 0) -> list[int]:
        """Delete every base but the newest and ``keep`` before it, with their batches.
        After a compaction this physically erases what was deleted."""
        old = self._bases()[: -1 - keep]
        for number in old:
            for folder in (f"base-{number}", f"after-{number}"):
                delete(self.spark, f"{self.root}/{folder}")
        return old
