"""Helpers shared by the text operators: table access, Arrow batches and vectorised word hashing."""

from __future__ import annotations

import contextvars
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sinks.scratch import scratch as shared_dir

#: Bytes of text that a task turns into numpy arrays at a time.
BLOCK_BYTES = 1 << 20

_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """The tables that one run saves on its way; `result` is what the run leaves behind."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []
        self._outer: contextvars.Token | None = None

    def __enter__(self) -> Scratch:
        self._outer = _owner.set(self)
        return self

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """The rows, written as a table of the run around this one, if there is any."""
        path = _write(df, name)
        around = self._outer.old_value
        if isinstance(around, Scratch):
            around.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def forget(self, keep: int = 0) -> None:
        """Deletes all tables saved so far but the last `keep`."""
        gone = self.paths[: len(self.paths) - keep]
        for spark, path in gone:
            delete(spark, path)
        del self.paths[: len(gone)]

    def __exit__(self, *_) -> None:
        _owner.reset(self._outer)
        self.forget()


#: The run that tables saved now belong to; of its own in each thread.
_owner: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("owner", default=None)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _write(df: DataFrame, name: str) -> str:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def own_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which a `Scratch` around it deletes at its end."""
    path = shared_dir(spark, name)
    if (owner := _owner.get()) is not None:
        owner.paths.append((spark, path))
    return path


def saved(df: DataFrame, name: str = "saved") -> DataFrame:
    """The rows, written once to the shared folder and read from there, so that lost executors cost no recomputation.

    Within a `Scratch` the table is deleted at its end, else it stays until the folder is cleared.
    """
    path = _write(df, name)
    if (owner := _owner.get()) is not None:
        owner.paths.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that are sent to all tasks because they are frequent: at most this many, as each has more than one in so many rows.
HEAVY_KEYS, LIGHT_ROWS = 10_000, 1000


def join_once(rows: DataFrame, single: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Rows joined with a saved table of one row a key, whose column `size` says how many of the rows have the key.

    Keys with more than LIGHT_ROWS and more than one in HEAVY_KEYS of all rows go to all tasks, so their rows meet nowhere.
    """
    limit = max(LIGHT_ROWS, (single.agg(F.sum(size)).first()[0] or 0) // HEAVY_KEYS)
    heavy = F.broadcast(single.where(F.col(size) > limit).drop(size))  # HEAVY_KEYS rows at most
    light = single.where(F.col(size) <= limit).drop(size)
    if heavy.isEmpty():
        return rows.join(light, keys, how)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return rows.join(heavy, keys).unionByName(rest)


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about `most` bytes (one row at least).

    Yields (first row, row after the last, offsets from 0, UTF-8 bytes). Null is an empty text.
    """
    text = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = text.buffers()
    n = len(text)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_P = 0x9E3779B97F4A7C55
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64, for n positions."""
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


#: Byte tables: A-Z lower-cased; the white space that separates words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` in the bytes, and the first word of each row."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row, over the whole array."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = mix(h * _U64(0x9FB21C651E98DF25) + words[k : k + count])
    return h


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(over, schema)


def crc32_of_id(name: str) -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary"))
