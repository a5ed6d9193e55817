"""Line dedup over an incremental index: exact reference counts behind sharded cuckoo filters.

The index holds, for each line key, the number of documents that contain it (an exact table, written as
Parquet), and cuckoo filters, one per shard of the key space, of the keys whose count reaches the
threshold. `insert` and `delete` change the counts and put the keys that cross the threshold into or out
of the filters, so any batch of documents can be taken back; shards that have grown to twice their size are
divided. Filters never miss a key; what they let through is checked against the exact table before a line is dropped.

Up to `BROADCAST_KEYS` frequent keys, filters and keys go to all tasks, and lines are dropped in the scan. Beyond it the
lines' keys meet the filter of their shard in a task (`GROUP_KEYS` keys or so at a time), only those that pass meet the exact
table, and the documents meet what is left by the digest of their text, in `COPIES` parts, as copies share it.

Each row is a document, so repeated rows count again. A null or empty text is one empty line, which has
no key. Lines whose key is empty always stay. Extra columns are kept by `drop_lines`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_DOCS = 10
#: Keys for each filter shard, slots of a bucket, share of slots in use, moves before a filter grows.
SHARD_KEYS, SLOTS, LOAD, KICKS = 200_000, 4, 0.8, 200
#: Frequent keys (16 bytes each) that are sent to all tasks; beyond it keys that meet one filter at a time, and parts of equal texts.
BROADCAST_KEYS, GROUP_KEYS, COPIES = 1_000_000, 1_000_000, 32


class CuckooFilter:
    """16-bit fingerprints, partial-key cuckoo hashing; supports deletion. Keys are pairs of uint64."""

    def __init__(self, capacity: int):
        buckets = 1 << max(1, int(np.ceil(capacity / LOAD / SLOTS)) - 1).bit_length()
        self.slots = np.zeros((buckets, SLOTS), np.uint16)

    @property
    def _mask(self) -> int:
        return len(self.slots) - 1

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (hi & np.uint64(self._mask)).astype(np.int64)
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark):
        return (common.mix(np.asarray(mark, np.uint64)) & np.uint64(self._mask)).astype(np.int64)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Adds each key once more; returns the positions of keys that found no place (their marks are all still there)."""
        failed = []
        for i, (mark, a, b) in enumerate(zip(*(x.tolist() for x in self._places(hi, lo)), strict=True)):
            if not (self._put(a, mark) or self._put(b, mark) or self._move(b, mark)):
                failed.append(i)
        return np.array(failed, np.int64)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = mark
        return bool(len(free))

    def _move(self, bucket: int, mark: int) -> bool:
        path = []
        for k in range(KICKS):
            slot = k % SLOTS
            out = int(self.slots[bucket, slot])
            self.slots[bucket, slot] = mark
            path.append((bucket, slot, out))
            mark, bucket = out, bucket ^ int(self._jump(np.array([out]))[0])
            if self._put(bucket, mark):
                return True
        for bucket, slot, out in reversed(path):
            self.slots[bucket, slot] = out
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Removes keys that were inserted before."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(hi, lo)), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.slots[bucket] == mark)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hi, lo)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(1)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        """A filter with all keys, as large as that takes."""
        capacity = max(64, len(hi))
        while len((made := cls(capacity)).insert(hi, lo)) > 0:
            capacity *= 2
        return made


def key_of(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased (bytes.strip takes just [\\x20\\x09-\\x0D])."""
    return line.strip().lower()


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _row_bytes(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    for _, _, at, raw in common.blocks(common.column(batch, text)):
        data = raw.tobytes()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield data[a:b]


def _keys_of(row: bytes) -> list[bytes]:
    """The distinct key digests of a text."""
    return _keys_of_lines(row.split(b"\n"))


def _keys_of_lines(lines: list[bytes]) -> list[bytes]:
    return [_digest(k) for k in {key_of(line) for line in lines} if k]


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """(key, n_docs): each document counts once for a key; tasks add up what they can before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, int] = {}
            for row in _row_bytes(batch, text):
                for key in _keys_of(row):
                    counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["key", "n_docs"])

    return docs.select(text).mapInArrow(run, "key binary, n_docs long").groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


@dataclass
class LineIndex:
    """An index version: Parquet tables `counts` (key, n_docs) and `filters` (shard, data) below `path`."""

    spark: SparkSession
    path: str
    min_docs: int
    shards: int

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("key binary, n_docs long").parquet(f"{self.path}/counts")

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, data binary").parquet(f"{self.path}/filters")

    @property
    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("key")

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, path: str | None = None) -> LineIndex:
        spark = docs.sparkSession
        made = cls(spark, path or common.own_dir(spark, "lines"), min_docs, 1)
        _counts(docs, text).write.parquet(f"{made.path}/counts")
        made.shards = 1 + made.frequent.count() // SHARD_KEYS

        made._build_filters(made.frequent).write.parquet(f"{made.path}/filters")
        return made

    def _build_filters(self, keys: DataFrame) -> DataFrame:
        """A filter for each shard of the keys."""

        def build(group: pa.Table) -> pa.Table:
            data = CuckooFilter.of(*_halves(group["key"].to_pylist())).dump()
            return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

        return keys.withColumn("shard", self._shard()).groupBy("shard").applyInArrow(build, "shard int, data binary")

    def _shard(self):
        return F.pmod(F.crc32("key"), F.lit(self.shards)).cast("int")

    def insert(self, docs: DataFrame, text: str = "text", path: str | None = None) -> LineIndex:
        """The next version, with these documents."""
        return self._changed(docs, text, 1, path)

    def delete(self, docs: DataFrame, text: str = "text", path: str | None = None) -> LineIndex:
        """The next version, without these documents, which must have been inserted before: a line whose count would fall below zero is
        a ValueError, and nothing is written."""
        return self._changed(docs, text, -1, path)

    def _changed(self, docs: DataFrame, text: str, sign: int, path: str | None) -> LineIndex:
        after = LineIndex(self.spark, path or common.own_dir(self.spark, "lines"), self.min_docs, self.shards)
        delta = _counts(docs, text).select("key", (F.col("n_docs") * sign).alias("d"))
        both = self.counts.join(delta, "key", "full").select("key", F.coalesce("n_docs", F.lit(0)).alias("old"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n_docs"))
        if sign < 0 and not both.where("n_docs < 0").isEmpty():
            raise ValueError("documents to delete hold lines that fewer documents of the index have")
        both.where("n_docs > 0").select("key", "n_docs").write.parquet(f"{after.path}/counts")
        n_frequent = after.frequent.count()
        if n_frequent > 2 * SHARD_KEYS * self.shards:
            after.shards = 1 + n_frequent // SHARD_KEYS
            after._build_filters(after.frequent).write.parquet(f"{after.path}/filters")
            return after
        crossed = (
            delta.join(self.counts, "key", "left")
            .select("key", F.coalesce("n_docs", F.lit(0)).alias("old"), (F.coalesce("n_docs", F.lit(0)) + F.col("d")).alias("new"))
            .where((F.col("old") >= self.min_docs) != (F.col("new") >= self.min_docs))
            .select(self._shard().alias("shard"), "key", (F.col("new") >= self.min_docs).alias("enters"))
        )

        def change(filters: pa.Table, keys: pa.Table) -> pa.Table:
            filter_ = CuckooFilter.load(filters["data"][0].as_py()) if filters.num_rows else CuckooFilter(64)
            for enters in (False, True):
                part = keys.filter(pc.equal(keys["enters"], enters))
                if not part.num_rows:
                    continue
                halves = _halves(part["key"].to_pylist())
                if not enters:
                    filter_.delete(*halves)
                elif len(filter_.insert(*halves)):
                    return pa.table({"shard": pa.array([part["shard"][0].as_py()], pa.int32()), "data": pa.array([None], pa.binary())})
            shard = (filters if filters.num_rows else keys)["shard"][0].as_py()
            return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([filter_.dump()], pa.binary())})

        changed = common.saved(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(change, "shard int, data binary"))
        full = [r.shard for r in changed.where("data is null").select("shard").collect()]
        if full:  # a filter ran out of room: those shards are built anew from the exact table
            again = after._build_filters(after.frequent.where(after._shard().isin(full)))
            changed = changed.where("data is not null").unionByName(again)
        changed.write.parquet(f"{after.path}/filters")
        return after

    def hits(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(text_digest, keys): the frequent keys of each distinct text that has any. Keys meet the filter of their shard first."""
        refs = self.counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
        salts = 1 + refs // (self.shards * GROUP_KEYS)

        def list_keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, keys = [], []
            for row in _row_bytes(batch, text):
                own = _keys_of(row)
                keys += own
                texts += [hashlib.sha256(row).digest()] * len(own) if own else []
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(keys, pa.binary())], names=["text_digest", "key"])

        def passing(keys: pa.Table, filters: pa.Table) -> pa.Table:
            out = keys.select(["text_digest", "key"])
            if not keys.num_rows or not filters.num_rows:
                return out.slice(0, 0)
            return out.filter(pa.array(CuckooFilter.load(filters["data"][0].as_py()).contains(*_halves(keys["key"].to_pylist()))))

        listed = common.arrow_map(docs.select(text), list_keys, "text_digest binary, key binary").distinct()
        dealt = listed.withColumn("shard", self._shard()).withColumn("salt", F.pmod(F.xxhash64("text_digest", "key"), F.lit(int(salts))).cast("int"))
        copies = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))))
        likely = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(passing, "text_digest binary, key binary")
        exact = common.saved(self.frequent.join(likely.groupBy("key").agg(F.count("*").alias("size")), "key"))
        return common.join_once(likely, exact, ["key"], "size").groupBy("text_digest").agg(F.collect_list("key").alias("keys"))

    def _known(self) -> tuple[dict[int, bytes], bytes] | None:
        """The filters and the sorted frequent keys, if these are few enough."""
        if self.frequent.count() > BROADCAST_KEYS:
            return None
        keys = b"".join(sorted(k for k in self.frequent.toArrow()["key"].to_pylist()))
        return {r.shard: r.data for r in self.filters.collect()}, keys

    def drop_lines(self, docs: DataFrame, text: str = "text", kept: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
        """The documents with the frequent lines of `text` left out in `kept`; two counts (lines, dropped) on request."""
        fields = [f for f in docs.schema.fields if f.name not in (kept, *(counts or ()))]
        out = T.StructType([*fields, T.StructField(kept, T.StringType()), *(T.StructField(c, T.LongType()) for c in counts or ())])
        names = [f"_c{i}" for i in range(len(fields))]
        plain = docs.select(F.col(text).alias("_text"), *(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)))
        known = self._known()
        if known:
            sent, shards, rows = self.spark.sparkContext.broadcast(known), self.shards, plain
        else:
            digest = F.unhex(F.sha2(F.coalesce(F.col("_text"), F.lit("")).cast("binary"), 256))
            salt = F.pmod(F.xxhash64(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]), F.lit(COPIES)).cast("int")
            hits = self.hits(docs, text).withColumnRenamed("text_digest", "_digest").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
            rows = plain.withColumns({"_digest": digest, "_salt": salt}).join(hits, ["_digest", "_salt"], "left").select("_text", "keys", *names)

        def listed(batch: pa.RecordBatch, lo: int, hi: int, lines: list[list[bytes]]) -> list[set[bytes]]:
            return [set(x) if x else set() for x in common.column(batch, "keys").slice(lo, hi - lo).to_pylist()]

        def frequent(batch: pa.RecordBatch, lo: int, hi: int, lines: list[list[bytes]]) -> list[set[bytes]]:
            filters, table = loaded(sent)
            own = [_keys_of_lines(x) for x in lines]
            every = list({k for x in own for k in x})
            if not every or not len(table):
                return [set() for _ in lines]
            shard, (hi_, lo_) = np.fromiter((zlib.crc32(k) % shards for k in every), np.int64, len(every)), _halves(every)
            passed = np.zeros(len(every), bool)
            for s, f in filters.items():
                at = np.flatnonzero(shard == s)
                passed[at] = f.contains(hi_[at], lo_[at])
            some = np.array(every, "S16")[passed]
            place = np.searchsorted(table, some)
            place[place == len(table)] = 0
            gone = {every[k] for k in np.flatnonzero(passed)[table[place] == some].tolist()}
            return [gone.intersection(x) for x in own]

        find = frequent if known else listed

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            values = common.column(batch, "_text")
            for lo, hi, at, raw in common.blocks(values):
                data, texts, n_lines, n_dropped = raw.tobytes(), [], [], []
                split = [data[a:b].split(b"\n") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for k, (lines, gone) in enumerate(zip(split, find(batch, lo, hi, split), strict=True), lo):
                    left = [x for x in lines if not (key := key_of(x)) or _digest(key) not in gone] if gone else lines
                    texts.append(None if not values[k].is_valid else b"\n".join(left))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                part = batch.slice(lo, hi - lo)
                arrays = [common.column(part, n) for n in names] + [pa.array(texts, pa.binary()).cast(pa.string())]
                if counts:
                    arrays += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

        return common.arrow_map(rows, run, out)


def loaded(sent) -> tuple[dict[int, CuckooFilter], np.ndarray]:
    """The filters and keys of a broadcast, once for each Python worker."""
    if _loaded.get("of") is not sent.value:
        filters, keys = sent.value
        _loaded.update(of=sent.value, value=({k: CuckooFilter.load(v) for k, v in filters.items()}, np.frombuffer(keys, "S16")))
    return _loaded["value"]


_loaded: dict = {}
