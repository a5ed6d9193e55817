"""A cache of finalized blocks by query: Parquet folders by query hash, an entry for each stretch of blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.joins import contiguous_prefix
from ledgerloom.sinks.manifest import Manifest


class BlockCache:
    """Entries are listed in a manifest per query hash, so readers never see one half written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, number: str = "number"):
        self.spark, self.path, self.schema, self.number = spark, path, schema, number

    def _manifest(self, query_hash: str) -> Manifest:
        return Manifest(self.spark, f"{self.path}/query_hash={query_hash}")

    def entries(self, query_hash: str) -> DataFrame:
        rows = [(query_hash, *e) for e in self._manifest(query_hash).read().get("entries", [])]
        return self.spark.createDataFrame(rows, "query_hash string, block_from long, block_to long, folder string")

    def store(self, query_hash: str, requested_from: int, blocks: DataFrame, finalized: int | None) -> None:
        """Keeps the blocks up to the finalized head (0 is one; without a head nothing is kept), from where they were asked for."""
        if finalized is None:
            return
        final = blocks.where(F.col(self.number) <= finalized)
        top = final.agg(F.max(self.number)).first()[0]
        if top is None:
            return
        manifest, folder = self._manifest(query_hash), f"blocks-{uuid.uuid4().hex}"
        final.write.parquet(f"{manifest.path}/{folder}")
        kept = [e for e in manifest.read().get("entries", []) if e[0] != requested_from]
        manifest.commit({"entries": [*kept, [requested_from, top, folder]]})

    def replay(self, query_hash: str, start: int) -> tuple[DataFrame, int]:
        """(blocks, next block to ask for): the entries that follow each other from the one at exactly `start`."""
        found = contiguous_prefix(self.entries(query_hash), start).orderBy("block_from").collect()  # a row for each entry
        if not found:
            return self.spark.createDataFrame([], self.schema), start
        paths = [f"{self.path}/query_hash={query_hash}/{e.folder}" for e in found]
        return self.spark.read.schema(self.schema).parquet(*paths), found[-1].block_to + 1
