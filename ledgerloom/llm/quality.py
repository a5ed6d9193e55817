"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of word bytes or of punctuation, with A-Z lower-cased. They are hashed into `BUCKETS`. Each bucket has a fixed sparse
random index vector; its word vector is the sum of the index vectors of all its neighbours (two tokens on either
side) over all documents, scaled to length 1, plus its own index vector. A document is the mean of its tokens'
vectors and the mean of the products of neighbouring ones, which tells repetition from variety. The network is trained on `SAMPLE` labelled documents at most, those whose ids have the smallest hashes, four
fifths for weights and a fifth for the temperature.

Null and empty texts have the zero vector and are scored like any other. Labels other than 0 and 1 are
ignored; of several labels of one document the smallest counts. Without labels of both kinds every score is 0.5.
Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .langid import held_out, learnable

BUCKETS, DIM, ONES, WINDOW = 1 << 13, 48, 2, 2
POOLED = 2 * DIM
SAMPLE, HIDDEN, EPOCHS, RATE, DECAY = 6000, 24, 60, 0.01, 1e-4
THRESHOLD = 0.7
#: Bytes of text that are learned from or pooled at a time: a token has three rows of DIM numbers while it is pooled, some 150 bytes for each of its text.
BLOCK_BYTES = 1 << 17

_KIND = np.ones(256, np.uint8)  # 0 white space, 1 word, 2 punctuation
_KIND[: 33] = 0
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the ONES entries of each bucket's index vector."""
    rng = np.random.default_rng(0)
    return rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :ONES], rng.choice([-1.0, 1.0], (BUCKETS, ONES))


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a block's tokens, and the first token of each row."""
    kind = _KIND[data]
    edge = np.empty(len(data), bool)
    edge[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    h = common.span_hashes(common.LOWER[data], starts, ends)
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """BUCKETS x DIM, from all texts; each task sends a row of numbers for each bucket it met."""
    place, sign = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for _, _, at, raw in common.blocks(common.column(batch, text), BLOCK_BYTES):
                ids, first = tokens(at, raw)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for d in range(1, WINDOW + 1):
                    if len(ids) <= d:
                        continue
                    near = row[d:] == row[:-d]
                    left, right = ids[:-d][near], ids[d:][near]
                    for a, b in ((left, right), (right, left)):
                        for k in range(ONES):
                            sums += np.bincount(a * DIM + place[b, k], sign[b, k], minlength=len(sums))
        sums = sums.reshape(BUCKETS, DIM)
        met = np.flatnonzero(np.abs(sums).sum(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * DIM), pa.array(sums[met].astype(np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), values], names=["bucket", "v"])

    parts = docs.select(text).mapInArrow(run, "bucket int, v array<float>")
    total = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[k].cast("double")).alias(f"v{k}") for k in range(DIM)])
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    got = total.toArrow()
    if got.num_rows:
        vectors[got["bucket"].to_numpy()] = np.stack([got[f"v{k}"].to_numpy() for k in range(DIM)], 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    for k in range(ONES):
        vectors[np.arange(BUCKETS), place[:, k]] += sign[:, k].astype(np.float32) / np.sqrt(ONES)
    return vectors


def pool(offsets: np.ndarray, data: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of each row the mean token vector and the mean product of neighbouring ones, zero without them."""
    ids, first = tokens(offsets, data)
    size, n = np.diff(first), len(first) - 1
    out = np.zeros((n, POOLED), np.float32)
    filled = np.flatnonzero(size)
    if len(filled):
        known = vectors[ids]
        out[filled, :DIM] = np.add.reduceat(known, first[:-1][filled], axis=0) / size[filled, None]
        near = np.zeros_like(known)
        near[:-1] = known[:-1] * known[1:]
        near[first[1:][filled] - 1] = 0
        out[filled, DIM:] = np.add.reduceat(near, first[:-1][filled], axis=0) / np.maximum(size[filled, None] - 1, 1)
    return out


@dataclass
class Network:
    """tanh hidden layer, logistic output; inputs are standardised first."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the log-loss over batches of 64; every fifth row only sets the temperature."""
        x, y = x.astype(np.float64), y.astype(np.float64)
        rng = np.random.default_rng(1)
        net = cls(x.mean(0), x.std(0) + 1e-3, rng.normal(0, POOLED**-0.5, (POOLED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
        if len(set(y.tolist())) < 2:
            net.w2 = np.zeros(HIDDEN)
            return net
        held = np.arange(len(y)) % 5 == 4
        a, t = (x[~held] - net.mean) / net.scale, y[~held]
        state = [[np.zeros_like(np.asarray(p)), np.zeros_like(np.asarray(p))] for p in (net.w1, net.b1, net.w2, net.b2)]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(t))
            for k in range(0, len(t), 64):
                rows = order[k : k + 64]
                h = np.tanh(a[rows] @ net.w1 + net.b1)
                e = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - t[rows]) / len(rows)
                back = np.outer(e, net.w2) * (1 - h * h)
                step += 1
                for i, (name, g) in enumerate((("w1", a[rows].T @ back + DECAY * net.w1), ("b1", back.sum(0)), ("w2", h.T @ e + DECAY * net.w2), ("b2", e.sum()))):
                    m, v = state[i] = [0.9 * state[i][0] + 0.1 * g, 0.999 * state[i][1] + 0.001 * g * g]
                    rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(net, name, getattr(net, name) - rate * m / (np.sqrt(v) + 1e-8))
        z, t = net.logits(x[held]), y[held]
        if len(t):  # Platt's targets, as even separable rows leave some doubt
            aim = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
            grid = np.exp(np.linspace(np.log(0.25), np.log(16), 81))
            loss = [(aim * np.logaddexp(0, -z / s) + (1 - aim) * np.logaddexp(0, z / s)).mean() for s in grid]
            net.temperature = float(grid[int(np.argmin(loss))])
        return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all texts, the network from labelled documents where `usable` (of the id) holds."""
    vectors = word_vectors(docs, text)
    known = labels.select(id_column, label).where(usable & F.col(label).isin(0, 1)).groupBy(id_column).agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col(id_column), F.lit("quality")), id_column).limit(sample)
    of_id = docs.select(id_column, F.col(text).alias("text")).join(F.broadcast(chosen), id_column)
    rows = of_id.select(F.col(id_column).alias("id"), "y", "text")  # `sample` ids at most
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, at, raw in common.blocks(common.column(batch, "text"), BLOCK_BYTES):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([common.column(part, "id").cast(pa.string()), common.column(part, "y"), pa.array(list(pool(at, raw, sent.value)), pa.list_(pa.float32()))], names=["id", "y", "v"])

    pooled = common.arrow_map(rows, run, "id string, y int, v array<float>")
    got = pooled.groupBy("id").agg(F.min(F.struct("y", "v")).alias("m")).select("id", "m.y", "m.v").toArrow().sort_by("id")  # one row an id
    x = np.array(got["v"].to_pylist(), np.float32).reshape(-1, POOLED)
    return QualityModel(vectors, Network.fit(x, got["y"].to_numpy()) if len(x) else Network(np.zeros(POOLED), np.ones(POOLED), np.zeros((POOLED, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0))


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 as `out`; a column of that name is replaced."""
    docs = docs.drop(out)
    fields = docs.schema.fields
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, at, raw in common.blocks(common.column(batch, text), BLOCK_BYTES):
            p = sent.value.network.probabilities(pool(at, raw, sent.value.vectors))
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(p)], names=schema.names)

    return common.arrow_map(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted); a quarter of the ids by crc32 is left out of learning."""
    model = train(docs, labels, learnable(id_column, 4, 2), id_column, text)
    scored = score(docs.select(id_column, text), model, text)
    return scored.select(id_column, held_out(id_column, 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
