"""Byte-level BPE encoding and decoding with segment trees.

Each piece of text (a match of the split pattern) keeps one segment tree whose leaves are its byte
positions. A leaf holds the rank of the pair that starts there, the root the leftmost minimum rank.
A merge changes three leaves: the merged pair's, its live left neighbour's and the right token's.
Pieces of similar length are merged together, one numpy row each, so a merge costs a few array
operations for thousands of pieces. Where there are only a few of a length (`ALONE`), each is merged by itself in a
tree of machine integers: log2(n) steps for each of up to n merges and 48 bytes of memory for each byte of the piece.

Nulls and empty texts give no ids. Repeated rows are encoded alike; extra columns are kept.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Entries of a task's cache of encoded words, and the longest word that enters it.
CACHE_ENTRIES, CACHE_WORD = 200_000, 40
#: Pieces of similar length that are merged one by one.
ALONE = 24
_NONE = np.iinfo(np.int64).max
_SHIFT = 32


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (self.ranks[token[:k]] << _SHIFT | self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.pairs = dict(pairs)
        self.pattern = regex.compile(pattern)
        self.cuts = self._may_cut()
        self.words: dict[str, bytes] = {}
        self.met = bytearray(1 << 23)  # by hash: words met in an earlier batch

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where the vocabulary doesn't merge it."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece after all merges; pieces are not empty."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.uint32)
            else:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in by_size.items():
            if len(members) <= ALONE:
                for i in members:
                    out[i] = self._merge_alone(pieces[i])
                continue
            step = max(1, (1 << 19) >> bits)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge_together([pieces[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge_together(self, pieces: list[bytes], leaves: int) -> list[np.ndarray]:
        """Merges pieces of at most `leaves` bytes; row r of each array is a piece, column its byte position."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(leaves) < sizes[:, None]
        ids = np.zeros((n, leaves + 1), np.int64)
        ids[:, :leaves][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, leaves + 2, dtype=np.int32), (n, leaves + 1)).copy()
        before = np.broadcast_to(np.arange(-1, leaves, dtype=np.int32), (n, leaves + 1)).copy()
        live = np.zeros((n, leaves + 1), bool)
        live[:, :leaves] = inside
        position = np.arange(leaves, dtype=np.int64)
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        rank = self.pair_rank(ids[:, :leaves].ravel(), ids[:, 1:].ravel()).reshape(n, leaves)
        paired = (position < sizes[:, None] - 1) & (rank != _NONE)
        tree[:, leaves:] = np.where(paired, rank << _SHIFT | position, _NONE)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        rows = np.flatnonzero(tree[:, 1] != _NONE) if leaves > 1 else np.zeros(0, np.int64)
        while len(rows):
            least = tree[rows, 1]
            at, merged = least & ((1 << _SHIFT) - 1), least >> _SHIFT
            right = after[rows, at]
            beyond = after[rows, right]
            ids[rows, at] = merged
            live[rows, right] = False
            after[rows, at] = beyond
            before[rows, np.minimum(beyond, leaves)] = at
            self._set(tree, leaves, rows, right, np.full(len(rows), _NONE))
            rank = np.where(beyond < sizes[rows], self.pair_rank(merged, ids[rows, np.minimum(beyond, leaves)]), _NONE)
            self._set(tree, leaves, rows, at, rank)
            left = before[rows, at]
            has = left >= 0
            if has.any():
                r, p = rows[has], left[has].astype(np.int64)
                self._set(tree, leaves, r, p, self.pair_rank(ids[r, p], merged[has]))
            rows = rows[tree[rows, 1] != _NONE]
        flat = ids[live].astype(np.uint32)
        return np.split(flat, np.cumsum(live.sum(1))[:-1])

    @staticmethod
    def _set(tree: np.ndarray, leaves: int, rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """A point update: the leaf and the minima on its path to the root."""
        tree[rows, leaves + at] = np.where(rank != _NONE, rank << _SHIFT | at, _NONE)
        node = (leaves + at) // 2
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node // 2

    def _merge_alone(self, piece: bytes) -> np.ndarray:
        """Merges one piece of any length."""
        n, pairs = len(piece), self.pairs
        leaves = 1 << max(1, (n - 1).bit_length())
        ids = array.array("q", [int(self.byte_ids[b]) for b in piece])
        after, before = array.array("q", range(1, n + 1)), array.array("q", range(-1, n - 1))
        tree = array.array("q", [_NONE]) * (2 * leaves)

        def key(left: int, right: int, at: int) -> int:
            rank = pairs.get(left << _SHIFT | right)
            return _NONE if rank is None else rank << _SHIFT | at

        def put(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        for i in range(n - 1):
            tree[leaves + i] = key(ids[i], ids[i + 1], i)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (least := tree[1]) != _NONE:
            at, merged = least & ((1 << _SHIFT) - 1), least >> _SHIFT
            right, left = after[at], before[at]
            beyond = after[right]
            ids[at], ids[right], after[at] = merged, -1, beyond
            put(right, _NONE)
            if beyond < n:
                before[beyond] = at
                put(at, key(merged, ids[beyond], at))
            else:
                put(at, _NONE)
            if left >= 0:
                put(left, key(ids[left], merged, left))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _may_cut(self) -> bool:
        """Whether this pattern's pieces end where `split` cuts, tried on all pairs of kinds of characters."""
        kinds = ["a", "Z", "9", ".", "'", "'s", "-", "_", "\u00e9", "\u65e5", "\u0301", "\U0001f600", "x1", "1x", "(", "$%"]
        texts = [f"{x}{gap}{y}" for x in kinds for y in kinds for gap in (" ", "\n")] + [f"{x} {y}\n{x} {x}" for x in kinds for y in kinds]
        return all([w for part in self._parts(t) for w in self.pattern.findall(part)] == self.pattern.findall(t) for t in texts)

    def split(self, text: str) -> list[str]:
        """Parts of a text whose borders are borders of pieces, too.

        A space between two characters that aren't white space always starts a piece and a line feed
        there always is one, so texts without longer runs of white space can be cut there and each word
        be encoded once. With patterns for which that doesn't hold, texts stay whole.
        """
        if not self.cuts or not text or text[0].isspace() or text[-1].isspace() or _wide(text):
            return [text] if text else []
        return self._parts(text)

    @staticmethod
    def _parts(text: str) -> list[str]:
        parts: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            parts.append(first)
            parts += [" " + x for x in rest]
            parts.append("\n")
        return parts[:-1]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.split(t) for t in texts]
        words, met, mask = self.words, self.met, len(self.met) - 1
        if len(words) > CACHE_ENTRIES:
            words.clear()
        found = [list(map(words.get, p)) for p in parts]
        lacks = [[k for k, x in enumerate(row) if x is None] for row in found]
        new = list({p[k] for p, at in zip(parts, lacks, strict=True) for k in at})
        if new:
            pieces = [[x.encode("utf-8", "surrogatepass") for x in self.pattern.findall(w)] for w in new]
            distinct = list({x for p in pieces for x in p})
            ids = dict(zip(distinct, (x.astype("<u4").tobytes() for x in self.merge(distinct)), strict=True))
            fresh = {w: b"".join([ids[x] for x in p]) for w, p in zip(new, pieces, strict=True)}
            for p, row, at in zip(parts, found, lacks, strict=True):
                for k in at:
                    row[k] = fresh[p[k]]
            for w, x in fresh.items():  # most words are rare, so only what is met again in a later batch is kept
                at = hash(w) & mask
                if met[at] and len(w) <= CACHE_WORD:
                    words[w] = x
                met[at] = 1
        return [b"".join(row) for row in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_wide = regex.compile(r"\s\s").search


@functools.cache
def codec(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """One codec for each Python worker."""
    return ByteBPE(path, pattern)


def _batches(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, list[str]]]:
    values = common.column(batch, text)
    for lo, hi, _, _ in common.blocks(values):
        yield lo, hi, common.strings(values.slice(lo, hi - lo))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds array<int> `out` with the ids of each text (a column of that name is replaced)."""
    docs = docs.drop(out)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for lo, hi, texts in _batches(batch, text):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(texts)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, array], names=[*part.schema.names, out])

    return common.arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(ids: DataFrame, column: str = "ids", out: str = "bytes", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds binary `out` with the bytes of each array of ids; null is an empty array."""
    ids = ids.drop(out)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        got = [bpe.decode(np.array(x or [], np.int64)) for x in common.column(batch, column).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, out])

    return common.arrow_map(ids, run, T.StructType([*ids.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes each text, decodes the ids, and returns id, number of ids and digests of both, without moving the ids."""
    schema = T.StructType([docs.schema[id_column], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for lo, hi, texts in _batches(batch, text):
            ids = bpe.encode_batch(texts)
            back = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            digest = [pa.array([hashlib.sha256(x).hexdigest() for x in v], pa.string()) for v in (ids, back)]
            yield pa.RecordBatch.from_arrays([common.column(batch, id_column).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), *digest], names=schema.names)

    return common.arrow_map(docs.select(id_column, text), run, schema)
