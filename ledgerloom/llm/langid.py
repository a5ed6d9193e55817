"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are the byte 2- and 3-grams of the text with A-Z lower-cased, hashed into `FEATURES` buckets;
weights are (1 + log count) * idf, scaled to length 1. Document frequencies come from all learnable
documents. The weights are trained by follow-the-regularised-leader with L1 and L2 penalties on a sample
of at most `SAMPLE` ids per language, `MOST` in all (those with the smallest hashes, so at every size the
same way; a row for each, counted in its task, so the driver gets up to `FEATURES` pairs of numbers for it), and a temperature
is fitted on every fifth document of a language, which training leaves out.

Null texts and texts without a letter are `und` with score 0. Without learnable rows all are. Repeated
rows are predicted alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FEATURES, SAMPLE, MOST, EPOCHS = 1 << 14, 500, 8000, 3
#: Of follow-the-regularised-leader: learning rate, its offset, the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"


def gram_buckets(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The buckets of each text's 2- and 3-grams, with repetitions."""
    c = common.LOWER[data].astype(np.uint32)
    two = c[:-1] | c[1:] << np.uint32(8) if len(c) > 1 else np.zeros(0, np.uint32)
    three = two[:-1] | c[2:] << np.uint32(16) | np.uint32(1 << 24) if len(c) > 2 else np.zeros(0, np.uint32)
    shift = np.uint32(32 - (FEATURES - 1).bit_length())
    two, three = ((x * np.uint32(0x9E3779B1) ^ x * np.uint32(0x85EBCA6B) >> np.uint32(7)) >> shift for x in (two, three))
    return [np.concatenate([two[a : max(a, b - 1)], three[a : max(a, b - 2)]]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def counts_of(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(buckets, minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: bytes) -> bool:
    return bool(_LETTER[np.frombuffer(text, np.uint8)].any()) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[at]
        length = float(np.sqrt((x * x).sum()))
        return at, x / length if length else x

    def probabilities(self, buckets: np.ndarray) -> np.ndarray:
        at, x = self.vector(*counts_of(buckets))
        return softmax((x @ self.weights[at] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log-loss, out of a grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic-net penalties; the bias (last row) carries none."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def solved(rows: np.ndarray) -> np.ndarray:
        free = (rows == FEATURES)[:, None]
        l1, l2 = np.where(free, 0, L1), np.where(free, 0, L2)
        w = -(z[rows] - np.sign(z[rows]) * l1) / ((BETA + np.sqrt(n[rows])) / ALPHA + l2)
        return np.where(np.abs(z[rows]) <= l1, 0, w)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(vectors)):
            at, x = vectors[i]
            rows, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = solved(rows)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[rows] += g - (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] += g * g
    w = solved(np.arange(FEATURES + 1))
    return w[:-1].astype(np.float32), w[-1]


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and all documents; FEATURES + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for _, _, at, raw in common.blocks(common.column(batch, text)):
                for buckets in gram_buckets(at, raw):
                    df[counts_of(buckets)[0]] += 1
                df[FEATURES] += len(at) - 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(df[found])], names=["bucket", "n"])

    df = np.zeros(FEATURES + 1, np.int64)
    for bucket, n in docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        df[bucket] = n
    return df[:FEATURES], int(df[FEATURES])


def train(docs: DataFrame, learnable: Column, id_column: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learns from the rows where `learnable` holds and text and language aren't null."""
    known = docs.where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(id_column, text, lang)
    df, total = document_frequencies(known, text)
    idf = np.log((1 + total) / (1 + df)) + 1
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    model = LanguageModel(sorted(sizes), idf)
    if not sizes:
        return model
    sample = min(sample, MOST // len(sizes))
    ids = known.groupBy(id_column).agg(F.min(lang).alias("_lang"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64(F.col(id_column), F.lit("language")), id_column))
    chosen = ids.withColumn("_place", place).where(F.col("_place") <= sample)  # Spark keeps `sample` rows of a language in each task before the shuffle
    rows = known.select(id_column, F.col(text).alias("_text")).join(F.broadcast(chosen), id_column).select(F.col(id_column).alias("id"), F.col("_lang").alias("lang"), F.col("_place").alias("place"), F.col("_text").alias("text"))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, at, raw in common.blocks(common.column(batch, "text")):
            counted = [counts_of(b) for b in gram_buckets(at, raw)]
            part = batch.slice(lo, hi - lo)
            lists = [pa.array([x[k].astype(np.int32) for x in counted], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([common.column(part, "id").cast(pa.string()), common.column(part, "lang"), common.column(part, "place"), *lists], names=["id", "lang", "place", "at", "n"])

    counted = common.arrow_map(rows, count, "id string, lang string, place int, at array<int>, n array<int>")
    got = counted.groupBy("id", "lang", "place").agg(F.min(F.struct("at", "n")).alias("m")).select("lang", "place", "m.*").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    labels = np.array([model.languages.index(x) for x in got["lang"].to_pylist()], np.int64)
    vectors = [model.vector(np.array(a), np.array(n)) for a, n in zip(got["at"].to_pylist(), got["n"].to_pylist(), strict=True)]
    held = got["place"].to_numpy() % 5 == 0  # of each language, so the first documents of a rare one are learnt
    model.weights, model.bias = ftrl([v for v, h in zip(vectors, held, strict=True) if not h], labels[~held], len(sizes))
    logits = np.array([x @ model.weights[at] + model.bias for (at, x), h in zip(vectors, held, strict=True) if h]).reshape(-1, len(sizes))
    model.temperature = fit_temperature(logits, labels[held])
    return model


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score)."""
    schema = T.StructType([docs.schema[id_column], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, names, scores = sent.value, [], []
        for _, _, at, raw in common.blocks(common.column(batch, text)):
            data = raw.tobytes()
            for buckets, a, b in zip(gram_buckets(at, raw), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if not model.languages or not has_letter(data[a:b]):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.probabilities(buckets)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
        yield pa.RecordBatch.from_arrays([common.column(batch, id_column), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return common.arrow_map(docs.select(id_column, text), run, schema)


def held_out(id_column: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether the id's fold is left out of learning; false for a null id, which isn't learnt from either."""
    return F.coalesce(common.crc32_of_id(id_column) % folds == fold, F.lit(False))


def learnable(id_column: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(common.crc32_of_id(id_column) % folds != fold, F.lit(False))
