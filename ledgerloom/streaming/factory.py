"""Contracts that a factory has made: a table of children that grows with the stream, goes back with forks, and can be filled ahead."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import abi
from ledgerloom.functions.scalars import parameter_filter
from ledgerloom.operators import joins
from ledgerloom.sinks.manifest import Manifest

CHILDREN = T.StructType(
    [
        T.StructField("child_address", T.StringType()),
        T.StructField("factory_address", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("transaction_index", T.LongType()),
        T.StructField("log_index", T.LongType()),
        T.StructField("event", T.StringType()),
    ]
)
PLACE = ["block_number", "transaction_index", "log_index"]


class ChildStore:
    """Children by address as versions of a Parquet table; the creation event is kept as JSON. The first one saved wins."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, Manifest(spark, path)

    def all(self) -> DataFrame:
        folder = self.manifest.read().get("folder")
        return self.spark.read.schema(CHILDREN).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], CHILDREN)

    def _replace(self, children: DataFrame) -> None:
        known, folder = self.manifest.read(), f"children-{uuid.uuid4().hex}"
        children.select(*CHILDREN.names).write.parquet(f"{self.path}/{folder}")
        self.manifest.commit({"folder": folder})
        if known.get("folder"):
            self.manifest.delete(known["folder"])

    def save(self, children: DataFrame) -> None:
        """Adds children that aren't there yet."""
        old = self.all()
        new = joins.first_by(children.select(*CHILDREN.names), ["child_address"], PLACE).join(old.select("child_address"), "child_address", "left_anti")
        self._replace(old.unionByName(new.select(*CHILDREN.names)))

    def remove_above(self, number: int) -> None:
        """After a fork to block `number`."""
        self._replace(self.all().where(F.col("block_number") <= number))

    def lookup(self, factories: Sequence[str] | None = None, params: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        return lookup_events(self.all(), factories, params)


def lookup_events(children: DataFrame, factories: Sequence[str] | None = None, params: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Children of these factories whose creation event (JSON) has the given values: any case, values ORed, parameters ANDed."""
    out = children if factories is None else children.where(F.lower("factory_address").isin([f.lower() for f in factories]))
    return out.where(parameter_filter(F.col("event"), dict(params or {})))


class Factory:
    """Children come from an event of the factory contracts; `child` names its parameter or is an expression on column `e`."""

    def __init__(self, store: ChildStore, addresses: Sequence[str], event: abi.Event, child: str | Column, params: Mapping[str, Sequence[str]] | None = None):
        self.store, self.addresses, self.event, self.params = store, [a.lower() for a in addresses], event, params
        self.child = F.col(f"e.{child}") if isinstance(child, str) else child

    def creations(self, logs: DataFrame) -> DataFrame:
        """Creation events in logs (address, topics, data and their place), of any emitter: `lookup` tests that."""
        rows = logs.where(abi.is_event(self.event)).withColumn("e", abi.event_column(self.event))
        child = F.lower(self.child)
        place = {"transaction_index": "transactionIndex", "log_index": "logIndex"}
        columns = [F.col(c if c in logs.columns else place.get(c, c)).cast("long").alias(c) for c in PLACE]
        made = rows.select(child.alias("child_address"), F.lower("address").alias("factory_address"), *columns, F.to_json("e").alias("event"))
        return joins.first_by(made.where("child_address is not null and child_address <> ''"), ["child_address"], PLACE).select(*CHILDREN.names)

    def children(self, logs: DataFrame) -> DataFrame:
        """All known children that the factory's filter lets through, those created in these logs included (they come first)."""
        fresh = self.creations(logs)
        stored = self.store.all().join(fresh.select("child_address"), "child_address", "left_anti")
        return lookup_events(fresh.unionByName(stored.select(*CHILDREN.names)), self.addresses, self.params)

    def of_children(self, logs: DataFrame) -> DataFrame:
        """Logs of child contracts with their creation: before or after it."""
        found = self.children(logs).select(F.col("child_address").alias("_child"), "factory_address", F.struct("block_number", "event").alias("creation"))
        return logs.join(found, F.lower("address") == F.col("_child")).drop("_child")

    def remember(self, logs: DataFrame) -> None:
        self.store.save(self.creations(logs))

    def index_ahead(self, blocks: DataFrame, last: int) -> int:
        """Saves the children created up to a block before the stream starts; returns how many are known then."""
        from ledgerloom.plans.query import Query
        from ledgerloom.plans.ranges import Range

        query = Query("evm").add_request("logs", Range(0, last), address=self.addresses, topic0=[self.event.topic0])
        self.remember(query.run(blocks)["logs"])
        return self.store.all().count()

    def rollback(self, number: int) -> None:
        self.store.remove_above(number)
