"""Token-id files: one concatenated id array per shard and Elias-Fano coded document boundaries.

Documents are put in ascending order of id, split into shards by ranges of the id, and each shard is a run
of blocks of about `BLOCK_IDS` ids. A block row of the Parquet files holds

    shard, block, start (ids of the shard before it), doc_ids,
    ids: little-endian unsigned 16- or 32-bit integers (`width` bytes each),
    bounds: the Elias-Fano code of the documents' ends within the block

so a boundary takes about 2 + log2(mean length) bits. Documents don't straddle blocks. Null and empty texts hold
the end id alone. Documents with equal ids follow each other, ordered by the bytes of their token ids; null ids come first.

Shards are ranges of the documents' ids, found from these alone. Texts are encoded where they are read, and token ids go straight to
their shard, so nothing is encoded twice and no text is shuffled. The tokenizer's own special tokens count
where a text spells them, as in the library.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2
BLOCK_IDS, CACHE_ENTRIES, CACHE_WORD = 1 << 19, 700_000, 40
#: One position in so many ones of the upper bits is kept for select().
SAMPLE = 64


@dataclass
class EliasFano:
    """A non-decreasing sequence: the lower `low_bits` bits packed, the upper parts in unary."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        upper = (values >> np.uint64(low_bits)).astype(np.int64)
        ones = upper + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].reshape(count, self.low_bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i):
        """Value i, or those of an array of places: only the upper bits between the sampled ones around them are read."""
        at = np.atleast_1d(np.asarray(i, np.int64))
        if not len(at):
            return np.zeros(0, np.int64)
        low, high = int(at.min()), int(at.max())
        if low < 0 or high >= self.n:
            raise IndexError(i)
        first, beyond = low // SAMPLE, high // SAMPLE + 1
        begin = int(self.samples[first])
        end = int(self.samples[beyond]) if beyond < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little")
        bits[: begin % 8] = 0
        ones = np.flatnonzero(bits) + begin // 8 * 8
        out = (ones[at - first * SAMPLE] - at << self.low_bits) + self._lows(low, high - low + 1)[at - low]
        return int(out[0]) if np.ndim(i) == 0 else out

    def values(self) -> np.ndarray:
        return self.select(np.arange(self.n))

    def dump(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = np.frombuffer(data, "<u4", 4).tolist()
        raw = np.frombuffer(data, np.uint8, offset=16)
        return cls(n, low_bits, raw[:a], raw[a : a + b], np.frombuffer(data, "<u4", offset=16 + a + b))


class WordTokenizer:
    """A tokenizer whose pre-tokenizer drops white space, so each word between spaces is encoded once. Others encode whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.type = "<u2" if self.inner.get_vocab_size() <= 1 << 16 else "<u4"
        self.bar = self.inner.encode("|", add_special_tokens=False).ids
        encoded = lambda w: np.array(self.inner.encode(w, add_special_tokens=False).ids, self.type).tobytes()
        self.tails = {x: encoded(x) for x in ".," if encoded("a" + x) == encoded("a") + encoded(x)}
        self.lowers = encoded("aB") == encoded("ab") and encoded("Q") == encoded("q")
        added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)", re.I)
        kinds = ["a", "Bc", *added[:4], "9", ".", "'s", "-", "a|b", "\u00e9", "\u65e5", "\u0301x", "\U0001f600"]
        gaps = (" ", "\n", "  ", " \n")
        self.cuts = not any(x.split() != [x] for x in added) and encoded("") == encoded(" ") == b"" and all(encoded(f"{x}{g}{y}") == encoded(x) + encoded(y) for x in kinds for y in kinds for g in gaps)
        self.words: dict[str, bytes] = {}
        self.met = bytearray(1 << 23)  # by hash: words met in an earlier batch

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word's ids. Many words are encoded as one text with bars between them, which costs much less a word."""
        barred = [w for w in words if "|" in w]
        plain = [w for w in words if "|" not in w]
        groups = [plain[k : k + 100] for k in range(0, len(plain), 100)]
        encoded = (e for k in range(0, len(groups), 50) for e in self.inner.encode_batch_fast([" | ".join(g) for g in groups[k : k + 50]], add_special_tokens=False))
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, self.type)
            at = np.flatnonzero(ids == self.bar[0])
            if len(self.bar) != 1 or len(at) != len(group) - 1:
                barred += group
                continue
            size, data = ids.itemsize, ids.tobytes()
            yield from zip(group, (data[a:b] for a, b in zip([0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(data)], strict=True)), strict=True)
        for w, e in zip(barred, self.inner.encode_batch(barred, add_special_tokens=False), strict=True):
            yield w, np.array(e.ids, self.type).tobytes()

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Arrow finds the distinct words of the batch, each is looked up or encoded once, and
        numpy puts the ids together."""
        if not self.cuts:
            return [np.array(e.ids, self.type).tobytes() for e in self.inner.encode_batch(common.strings(texts), add_special_tokens=False)]
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        words, met, mask = self.words, self.met, len(self.met) - 1
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(words.get, distinct))
        lacks = [k for k, x in enumerate(found) if x is None]
        cores = {k: self._core(distinct[k]) for k in lacks}
        known = {c: words[c] for c, _ in cores.values() if c in words}
        known.update(self.encode_words(list({c for c, _ in cores.values()} - known.keys())))
        for k, (core, tail) in cores.items():  # most words are rare, so only what is met again in a later batch is kept
            found[k], w = known[core] + tail, distinct[k]
            at = hash(w) & mask
            if met[at] and len(w) <= CACHE_WORD:
                words[w] = found[k]
            met[at] = 1
        kind = np.dtype(self.type)
        ids = np.frombuffer(b"".join(found), kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        start, code = np.cumsum(size) - size, coded.indices.to_numpy()
        length = size[code]
        ends = np.cumsum(length)
        place = np.repeat(start[code] - (ends - length), length)
        place += np.arange(len(place))
        data = ids[place].tobytes()
        rows = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()] * kind.itemsize
        return [data[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]

    def _core(self, word: str) -> tuple[str, bytes]:
        """A word that is encoded alike and met more often, and the ids to add: without a full stop or comma
        after a letter, which is a piece of its own, and in lower case, which the tokenizer turns ASCII letters to. Words
        that may hold a special token stay as they are."""
        if self.special.search(word):
            return word, b""
        tail = self.tails.get(word[-1:]) if word[-2:-1].isalpha() else None
        core = word if tail is None else word[:-1]
        return core.lower() if self.lowers and core.isascii() else core, tail or b""


def _span(bounds: EliasFano, k: int) -> tuple[int, int]:
    return bounds.select(k - 1) if k else 0, bounds.select(k)


def _range_ends(ids: DataFrame) -> list:
    """The last id of each of Spark's ranges of the ids but the highest one; nulls lie in the first. A value for each shard comes to the driver."""
    shards = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ids.repartitionByRange(shards, "id").groupBy(F.spark_partition_id()).agg(F.max("id").alias("last"))
    return sorted(r[0] for r in ranges.select("last").where("last is not null").collect())[:-1]


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)


@dataclass
class TokenFiles:
    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    @classmethod
    def write(cls, docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, tokenizer_path: str = TOKENIZER, end_id: int | None = END_ID) -> TokenFiles:
        spark = docs.sparkSession
        made = cls(spark, path or common.own_dir(spark, "tokens"))
        id_type = docs.schema[id_column].dataType
        schema = T.StructType([T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("block", T.IntegerType()), ("start", T.LongType()), ("n_ids", T.LongType()), ("width", T.IntegerType()), ("doc_ids", T.ArrayType(id_type)), ("ids", T.BinaryType()), ("bounds", T.BinaryType()))])
        given = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

        ends = _range_ends(given.select("id"))

        def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            encoder = tokenizer(tokenizer_path)
            end = b"" if end_id is None else np.array([end_id], encoder.type).tobytes()
            texts, ids = common.column(batch, "text"), common.column(batch, "id")
            for lo, hi, _, _ in common.blocks(texts, 4 << 20):
                coded = [x + end for x in encoder.encode_batch(texts.slice(lo, hi - lo))]
                shards = [0 if i is None else bisect_left(ends, i) for i in ids.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), ids.slice(lo, hi - lo), pa.array(coded, pa.binary())], names=["to", "id", "ids"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            width, shard = np.dtype(tokenizer(tokenizer_path).type).itemsize, TaskContext.get().partitionId()
            block, start, held, doc_ids, size = 0, 0, [], [], 0

            def row() -> pa.RecordBatch:
                ends = np.cumsum([len(x) // width for x in held])
                values = [[shard], [block], [start], [size // width], [width], [doc_ids], [b"".join(held)], [EliasFano.encode(ends).dump()]]
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=schema.names)

            types = None
            for batch in batches:
                ids = common.column(batch, "id")
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(ids.type), pa.binary(), pa.binary()]
                for i, x in zip(ids.to_pylist(), common.column(batch, "ids").to_pylist(), strict=True):
                    held.append(x)
                    doc_ids.append(i)
                    size += len(x)
                    if size >= BLOCK_IDS * width:
                        yield row()
                        block, start, held, doc_ids, size = block + 1, start + size // width, [], [], 0
            if held:
                yield row()

        coded = common.arrow_map(given, encode, T.StructType([T.StructField("to", T.IntegerType()), T.StructField("id", id_type), T.StructField("ids", T.BinaryType())]))
        dealt = coded.repartitionById(len(ends) + 1, "to").sortWithinPartitions("id", "ids")
        dealt.mapInArrow(pack, schema).write.parquet(made.path)
        return made

    def shard_starts(self) -> dict[int, int]:
        """Ids of all shards before each; a row for each shard, so as many as the files have partitions."""
        starts, total = {}, 0
        for shard, n in self.blocks.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect():
            starts[shard], total = total, total + n
        return starts

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids): start counts the ids of all documents before."""
        return self._each("ids array<int>", lambda ids: ids.astype(np.int32).tolist(), pa.list_(pa.int32()))

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32), from the files."""
        return self._each("ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())

    def look_up(self, doc_ids: list) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of these documents as `read` has them, without decoding the bounds of others. Null ids aren't found."""
        wanted = {i for i in doc_ids if i is not None}
        listed = F.array(*[F.lit(i) for i in sorted(wanted)]).cast(self.blocks.schema["doc_ids"].dataType)
        places = lambda row, first, bounds: [(k, *_span(bounds, k)) for k, x in enumerate(row["doc_ids"].as_py()) if x in wanted]
        return self._cut(F.arrays_overlap("doc_ids", listed), places)

    def document(self, k: int) -> DataFrame:
        """The k-th document in the files' order, from 0, as `read` has it; no row beyond the last."""
        size = F.sum(F.size("doc_ids"))
        for shard, n in self.blocks.groupBy("shard").agg(size).orderBy("shard").collect():
            if k < n:
                break
            k -= n
        else:
            return self._cut(F.lit(False), None)
        for block, n in self.blocks.where(F.col("shard") == shard).groupBy("block").agg(size).orderBy("block").collect():
            if k < n:
                break
            k -= n
        return self._cut((F.col("shard") == shard) & (F.col("block") == block), lambda row, first, bounds: [(k, *_span(bounds, k))])

    def window(self, start: int, n: int) -> DataFrame:
        """(doc_id, start, n_tokens, ids): the parts of documents that the n ids from position `start` of all ids hold."""
        starts = self.shard_starts()

        def places(row: dict, first: int, bounds: EliasFano) -> list[tuple[int, int, int]]:
            low, high, out = max(0, start - first), start + n - first, []
            k = bisect_right(range(bounds.n), low, key=bounds.select)  # the first document that ends beyond
            while k < bounds.n:
                a, b = _span(bounds, k)
                if a >= high or low >= high:
                    break
                out.append((k, max(a, low), min(b, high)))
                k += 1
            return out

        inside = [(F.col("shard") == s) & (F.col("start") < start + n - x) & (F.col("start") + F.col("n_ids") > start - x) for s, x in starts.items()]
        return self._cut(functools.reduce(lambda a, b: a | b, inside, F.lit(False)), places, starts)

    def _cut(self, where, places, starts: dict[int, int] | None = None) -> DataFrame:
        """Of the blocks `where`: (doc_id, start, n_tokens, ids) for each (document, from, to) that `places` gives."""
        starts = self.shard_starts() if starts is None else starts
        blocks = self.blocks.select("shard", "block", "start", "n_ids", "width", "doc_ids", "ids", "bounds")
        id_type = blocks.schema["doc_ids"].dataType.elementType

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                ids = np.frombuffer(row["ids"].as_buffer(), f"<u{row['width'].as_py()}")
                bounds, first = EliasFano.load(row["bounds"].as_py()), starts[row["shard"].as_py()] + row["start"].as_py()
                found = places(row, first, bounds)
                values = [[a + first for _, a, _ in found], [b - a for _, a, b in found], [ids[a:b].astype(np.int32).tolist() for _, a, b in found]]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values.take(pa.array([k for k, _, _ in found], pa.int64())), *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], names=["doc_id", "start", "n_tokens", "ids"])

        return common.arrow_map(blocks.where(where), run, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids array<int>")

    def _each(self, field: str, of, kind: pa.DataType) -> DataFrame:
        starts = self.shard_starts()
        blocks = self.blocks.select("shard", "start", "width", "doc_ids", "ids", "bounds")
        id_type = blocks.schema["doc_ids"].dataType.elementType
        name, _, spark_type = field.partition(" ")

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                ids = np.frombuffer(row["ids"].as_buffer(), f"<u{row['width'].as_py()}")
                bounds = EliasFano.load(row["bounds"].as_py())
                ends = bounds.select(np.arange(bounds.n))
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                first = starts[row["shard"].as_py()] + row["start"].as_py()
                values = [of(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(begin + first), pa.array(ends - begin), pa.array(values, kind)], names=["doc_id", "start", "n_tokens", name])

        return common.arrow_map(blocks, run, f"doc_id {id_type.simpleString()}, start long, n_tokens long, {name} {spark_type}")
