"""Rows in folders by block range, so that removing blocks reads and writes the folders of these blocks only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import remove


class BlockLayout:
    """A Parquet table partitioned by `number div width`; within a folder, files are cut and sorted by block number.

    Forks and range deletions delete whole folders and rewrite the ones at the ends of the range, by Spark's dynamic partition overwrite.
    Each step can be run again after a crash: it asks for what the table already is. One writer at a time. Rows without a block number, or with a negative one, are refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, width: int, number: str = "block_number", part: str = "block_range"):
        if width < 1 or part.lower() in {f.name.lower() for f in schema.fields}:
            raise ValueError(f"width {width} isn't positive, or the table has a column {part}")
        self.spark, self.path, self.schema, self.width, self.number, self.part = spark, path, schema, width, number, part

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def rows(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """The rows of blocks low to high, ends included; other folders aren't listed in the scan."""
        return self._stored().where(self._inside(low, high)).select(*self.schema.names)

    def fork(self, safe: int) -> None:
        """Blocks above `safe` go."""
        self.delete(safe + 1, None)

    def delete(self, low: int, high: int | None) -> None:
        """Blocks low to high go, ends included; without `high` all from `low` on."""
        if high is not None and high < low:
            return
        first, last = low // self.width, None if high is None else high // self.width
        ends = {k for k, cut in ((first, low % self.width), (last, high is not None and (high + 1) % self.width)) if cut}
        for k in sorted(self._folders(), reverse=True):
            if k >= first and (last is None or k <= last) and k not in ends:
                self._drop(k)
        for k in sorted(ends & set(self._folders()), reverse=True):
            left = self._stored().where((F.col(self.part) == k) & ~self._inside(low, high, folders=False)).select(*self.schema.names)
            self._rewrite(k, left)

    def compact(self, low: int | None = None, high: int | None = None) -> None:
        """Many small files of each folder in the range become few; rows stay."""
        inside = lambda k: (low is None or k >= low // self.width) and (high is None or k <= high // self.width)
        found = [k for k in self._folders() if inside(k)]
        if found:
            self._write(self._stored().where(F.col(self.part).between(min(found), max(found))).select(*self.schema.names), "overwrite")

    def _rewrite(self, k: int, left: DataFrame) -> None:
        if left.isEmpty():  # a folder without rows isn't part of what is overwritten
            self._drop(k)
        else:
            self._write(left, "overwrite")

    def _drop(self, k: int) -> None:
        remove(self.spark, f"{self.path}/{self.part}={k}")

    def _write(self, rows: DataFrame, mode: str) -> None:
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        wrong = F.col(self.number).isNull() | (F.col(self.number) < 0)
        placed = own.withColumn(self.part, F.when(wrong, F.raise_error(F.lit("a block number is missing or negative"))).otherwise(F.expr(f"`{self.number}` div {self.width}")))
        # the hash cuts a block with very many rows, too
        cut = placed.repartitionByRange(self.part, self.number, F.xxhash64(*[c for c in own.columns if not isinstance(own.schema[c].dataType, T.MapType)])).sortWithinPartitions(self.part, self.number)
        cut.write.partitionBy(self.part).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(self.path)

    def _inside(self, low: int | None, high: int | None, folders: bool = True) -> Column:
        number, part, out = F.col(self.number), F.col(self.part), F.lit(True)
        if low is not None:
            out = out & (number >= low) & ((part >= low // self.width) if folders else F.lit(True))
        if high is not None:
            out = out & (number <= high) & ((part <= high // self.width) if folders else F.lit(True))
        return out

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(self.part, T.LongType())])
        return self.spark.read.schema(full).parquet(self.path) if self._folders() else self.spark.createDataFrame([], full)

    def _folders(self) -> list[int]:
        top = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        listed = [x.getPath().getName() for x in files.listStatus(top)] if files.exists(top) else []
        return [int(m[1]) for name in listed if (m := re.fullmatch(rf"{re.escape(self.part)}=(\d+)", name))]
