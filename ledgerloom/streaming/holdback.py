"""Rows above the finality floor, held back in a table until they are final."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .finality import Cursor, PipeState


class HoldBack:
    """Held rows, one Parquet folder for each version; `arrival` keeps the order in which batches came.

    Each call returns the rows to deliver and the next version; nothing is changed in place, so a failed batch can be
    run again from the same version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, number: str = "block_number", version: int = 0):
        self.spark, self.path, self.schema, self.number, self.version = spark, path, schema, number, version

    def held(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("arrival", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{self.version}") if self.version else self.spark.createDataFrame([], schema)

    def push(self, rows: DataFrame, floor: int | None) -> tuple[DataFrame, HoldBack]:
        """(released, next): all rows at or below the floor, older arrivals first; without a floor everything is released."""
        after = self._next()
        every = self.held().unionByName(rows.withColumn("arrival", F.lit(after.version).cast("long")))
        final = F.lit(True) if floor is None else F.col(self.number) <= floor
        every.where(~final).write.mode("overwrite").parquet(f"{after.path}/v{after.version}")
        return every.where(final), after

    def drop_above(self, safe: int | None) -> HoldBack:
        """After a fork: rows above `safe` go; None keeps the rows."""
        after = self._next()
        kept = self.held() if safe is None else self.held().where(F.col(self.number) <= safe)
        kept.write.mode("overwrite").parquet(f"{after.path}/v{after.version}")
        return after

    def _next(self) -> HoldBack:
        return HoldBack(self.spark, self.path, self.schema, self.number, self.version + 1)


#: Keys of the state of a stream; a checkpoint keeps its number.
BUCKETS = 64
#: Rows that are handed on at a time.
ROWS = 10_000
#: What becomes of a row that no response releases.
WAITS, DROPPED = -1, -2
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_EVENT = "struct<seq: bigint, kind: string, number: bigint, payload: string>"


class _Waiting(StatefulProcessor):
    """Of one bucket: the rows that wait, by block number, and the floor so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "number bigint", "seqs array<bigint>, payloads array<string>")
        self.floor = handle.getValueState("floor", "number bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts: list[pa.Table] = []
        told: set[tuple[int, str, int | None]] = set()
        for part in rows:
            is_row = (part["kind"] == "row").to_numpy()
            for seq, kind, number in part.loc[~is_row, ["seq", "kind", "number"]].drop_duplicates().itertuples(index=False):
                told.add((int(seq), kind, None if pd.isna(number) else int(number)))
            own = part[is_row]
            parts.append(pa.table({"seq": pa.array(own["seq"], pa.int64()), "number": pa.array(own["number"].astype("int64"), pa.int64()), "payload": pa.array(own["payload"], pa.string())}))
        steps = self._steps(sorted(told, key=lambda c: c[0]))
        waiting: dict[int, list[tuple[int, str]]] = {}
        for came in parts:  # most rows are final or taken back by what came with them; no state is touched for these
            number, seq = came["number"].to_numpy(), came["seq"].to_numpy()
            fate = _fates(steps, number, seq)
            final = np.flatnonzero(fate >= 0)
            if len(final):
                yield pd.DataFrame({"number": number[final], "seq": seq[final], "released": fate[final], "payload": came["payload"].take(pa.array(final)).to_pandas()})
            still = came.take(pa.array(np.flatnonzero(fate == WAITS)))
            for n, at, payload in zip(*(still[c].to_pylist() for c in ("number", "seq", "payload")), strict=True):
                waiting.setdefault(n, []).append((at, payload))
        known = {k[0] for k in self.held.keys()}
        out: list[tuple[int, int, int, str]] = []
        for number in sorted(known | waiting.keys()):
            old, came = _fate(steps, number, None) if number in known else "drop", waiting.get(number, [])
            if old is None and not came:
                continue  # waits on, unread
            stored = [] if old == "drop" else list(zip(*self.held.getValue((number,)), strict=True))
            waits = ([] if old is not None else stored) + sorted(came, key=lambda c: c[0])
            if old is not None:
                out += [(number, seq, old, payload) for seq, payload in stored]
            if waits:
                self.held.updateValue((number,), ([s for s, _ in waits], [p for _, p in waits]))
            elif number in known:
                self.held.removeKey((number,))
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["number", "seq", "released", "payload"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["number", "seq", "released", "payload"])

    def _steps(self, told: list[tuple[int, str, int | None]]) -> list[tuple[int, str, float | None]]:
        """What is told, in order; the floor never falls, and while none is known everything is final."""
        top = self.floor.get()[0] if self.floor.exists() else None
        out: list[tuple[int, str, float | None]] = []
        for seq, kind, number in told:
            if kind == "floor":
                top = top if number is None or (top is not None and number < top) else number
                out.append((seq, kind, float("inf") if top is None else top))
            else:
                out.append((seq, kind, number))
        if top is not None:
            self.floor.update((top,))
        return out

    def close(self) -> None:
        pass


def _fate(steps: list[tuple[int, str, float | None]], number: int, seq: int | None) -> int | str | None:
    """The response that releases a row, "drop" for one that a fork takes back, None for one that waits. seq None: it came before all steps."""
    for at, kind, value in steps:
        if kind == "floor" and (seq is None or at >= seq) and number <= value:
            return at
        if kind == "fork" and (seq is None or at > seq) and value is not None and number > value:
            return "drop"
    return None


def _fates(steps: list[tuple[int, str, float | None]], number: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """`_fate` of rows: the response that releases each, DROPPED or WAITS."""
    fate, left = np.full(len(number), WAITS, np.int64), np.arange(len(number))
    for at, kind, value in steps:
        if not len(left):
            break
        if kind == "floor":
            met = (seq[left] <= at) & (number[left] <= value)
        elif value is not None:
            met = (seq[left] < at) & (number[left] > value)
        else:
            continue
        fate[left[met]] = at if kind == "floor" else DROPPED
        left = left[~met]
    return fate


def held_stream(responses: DataFrame, items: Column, schema: T.StructType, finalized: Column, fork: Column, safe: Column, number: str = "block_number", seq: str = "seq") -> DataFrame:
    """A stream of responses as the stream of their rows once they are final, with `released`, the response that released them.

    items: an array of rows (`schema`) for each response; finalized: its finalized block; where `fork` holds, rows above `safe` that came before are
    taken back (a null keeps them). Rows wait in Spark's own state store, spread over BUCKETS keys whatever their block; offsets and state are
    Spark's, so a query that starts again from its checkpoint goes on. Responses have to come in the order of `seq`, as many at
    once as may be. The floor never falls; until one is known rows are final at once. Rows without a number are left out.
    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    event = lambda kind, at, payload: F.struct(F.col(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), at.cast("bigint").alias("number"), payload.cast("string").alias("payload"))
    rows = F.filter(F.transform(items, lambda x: event("row", x.getField(number), F.to_json(x, _JSON))), lambda e: e["number"].isNotNull())
    control = F.when(fork, event("fork", safe, F.lit(None))).otherwise(event("floor", finalized, F.lit(None)))
    told = F.concat(F.coalesce(rows, F.array().cast(f"array<{_EVENT}>")), F.array(control))
    events = responses.select(F.explode(told).alias("e")).select("e.*")
    everywhere = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    own = F.array(F.pmod(F.xxhash64("number", "payload"), F.lit(BUCKETS)).cast("int"))
    keyed = events.withColumn("bucket", F.explode(F.when(F.col("kind") == "row", own).otherwise(everywhere)))
    found = keyed.groupBy("bucket").transformWithStateInPandas(_Waiting(), "number bigint, seq bigint, released bigint, payload string", "Append", "None")
    return found.select(F.from_json("payload", schema, _JSON).alias("row"), "released").select("row.*", "released")


def still_held(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The rows that wait in the state of a stopped query."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return state.select(F.explode("user_map_value.payloads").alias("p")).select(F.from_json("p", schema, _JSON).alias("row")).select("row.*")


def dump_state(state: PipeState) -> str:
    return json.dumps(asdict(state))


def load_state(text: str) -> PipeState:
    raw = json.loads(text)
    cursor = lambda x: None if x is None else Cursor(**x)
    return PipeState(cursor(raw["cursor"]), cursor(raw["finalized"]), tuple(Cursor(**x) for x in raw["chain"]), raw.get("applied", 0))
