"""Secret scan: fixed patterns plus character Markov models compared by log-likelihood ratio.

First-order models of random strings, of ordinary identifiers and of hashes are trained from labelled samples. Runs of key
characters, without what patterns found in them, are searched for stretches of 20 or more characters where the mean ratio of
random to ordinary reaches `MIN_RATIO`; a stretch ends where the sum has dropped by `DROP`. It grows to the next joint or end of
its run if that is near. Stretches that look more like hashes (hexadecimal digests, UUIDs), which name things, aren't reported.

`labelled_samples` makes the samples: random strings of the usual alphabets drawn with a fixed seed, and access keys that the
pattern finds; words of the texts, alone and joined as identifiers, paths and slugs, and rows of one character; hashes drawn likewise, and hexadecimal
numbers that the pattern finds. Of each kind found in texts it takes `SAMPLE` distinct strings, those with the smallest checksums.

Null and empty texts have no spans. Repeated rows give equal rows. Offsets are code points.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(rb"(?<![\w+/=.@-])[A-Za-z]{3,24}(?![\w+/=@-])")
MIN_CHARS, MIN_RATIO, DROP, NEAR, BACKOFF = 20, 0.7, 12.0, 6, 5.0
#: Distinct strings of each label taken from texts; strings drawn or joined for each label.
SAMPLE, DRAWN = 4000, 12_000
#: What random strings are drawn from.
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "abcdefghijklmnopqrstuvwxyz0123456789",
)

#: Symbols of the models; every other byte ends a string.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1
_CLASS = np.zeros(256, np.int64)
_CLASS[np.frombuffer(ALPHABET, np.uint8)] = np.arange(1, N)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the pattern matches."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def pair_counts(strings: list[bytes]) -> np.ndarray:
    """Counts of adjacent symbols (N x N, flat); symbol 0 stands for either end of a string."""
    symbols = _CLASS[np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", np.uint8)]
    counts = np.bincount(symbols[:-1] * N + symbols[1:], minlength=N * N)
    counts[0] = 0
    return counts


RANDOM, ORDINARY, HASH = 1, 0, 2


@dataclass
class Models:
    """Log-probabilities of symbol pairs by label."""

    logs: dict[int, np.ndarray]

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Models:
        """From the pair counts of ordinary, random and hash strings."""

        def logs(flat: np.ndarray) -> np.ndarray:
            c = flat.reshape(N, N).astype(np.float64)
            single = (c.sum(0) + 0.5) / (c.sum() + 0.5 * N)  # what rare first symbols fall back on
            return np.log((c + BACKOFF * single) / (c.sum(1, keepdims=True) + BACKOFF))

        return cls({label: logs(flat) for label, flat in enumerate(counts)})

    def ratios(self, string: bytes, against: int = ORDINARY) -> np.ndarray:
        """The log-likelihood ratio of random strings to others for each symbol pair."""
        s = _CLASS[np.frombuffer(string, np.uint8)]
        return self.logs[RANDOM][s[:-1], s[1:]] - self.logs[against][s[:-1], s[1:]]


def train(samples: DataFrame, string: str = "string", label: str = "label") -> Models:
    """Trains the models from labelled strings: 0 ordinary, 1 random, 2 hash; null rows and other labels are ignored.

    At most 3 * N * N rows reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, N * N), np.int64)
        for batch in batches:
            by: tuple[list[bytes], ...] = ([], [], [])
            for s, y in zip(common.column(batch, string).to_pylist(), common.column(batch, label).to_pylist(), strict=True):
                if s is not None and y in (0, 1, 2):
                    by[y].append(s.encode())
            for y in (0, 1, 2):
                counts[y] += pair_counts(by[y])
        kind, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[kind, pair])], names=["label", "pair", "n"])

    total = np.zeros((3, N * N), np.int64)
    for kind, pair, n in samples.select(string, label).mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n")).collect():
        total[kind, pair] = n
    return Models.from_counts(total)


def found_strings(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> DataFrame:
    """(label, string): of all words, access keys and hexadecimal numbers of the texts the `most` distinct ones with the smallest checksums."""

    def smallest(strings: set[bytes]) -> set[bytes]:
        return set(sorted(strings, key=lambda x: (zlib.crc32(x), x))[:most])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[set[bytes], ...] = (set(), set(), set())
        for batch in batches:
            for _, _, at, raw in common.blocks(common.column(batch, text)):
                data = raw.tobytes()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    row = data[a:b]
                    kept[ORDINARY].update(WORD.findall(row))
                    kept[RANDOM].update(x for x in ACCESS.findall(row) if len(x) >= MIN_CHARS)
                    kept[HASH].update(HEX.findall(row))
                kept = tuple(smallest(x) if len(x) > 20 * most else x for x in kept)
        rows = [(label, x.decode()) for label, x in enumerate(kept) for x in smallest(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["label", "string"])

    each = common.saved(docs.select(text).mapInArrow(run, "label int, string string").distinct().withColumn("sum", F.crc32(F.col("string").cast("binary"))))
    limits = each.groupBy("label").agg(F.count("*").alias("n"), F.percentile_approx("sum", [k / 100 for k in range(1, 101)], 10_000).alias("q")).collect()
    bound = F.lit(0)
    for r in limits:  # one percent more, as percentiles are approximate; the rest goes by rank
        k = min(99, 100 * most // max(r["n"], 1) + 1)
        bound = F.when(F.col("label") == r["label"], F.lit(1 << 32 if r["n"] <= most else r["q"][k])).otherwise(bound)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("sum", "string"))
    return each.where(F.col("sum") <= bound).withColumn("_rank", rank).where(F.col("_rank") <= most).select("label", "string")


def labelled_samples(docs: DataFrame, text: str = "text", most: int = SAMPLE, drawn: int = DRAWN) -> DataFrame:
    """(string, label): at most 3 * (most + drawn) rows and one for each symbol, the same for the same texts."""
    found: tuple[list[str], ...] = ([], [], [])
    with common.Scratch():
        for r in found_strings(docs, text, most).orderBy("label", "string").collect():
            found[r["label"]].append(r["string"])
    rng = random.Random(1)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    keys = [draw(ALPHABETS[k % len(ALPHABETS)], rng.randint(MIN_CHARS, 64)) for k in range(drawn)]
    hexes = [draw("0123456789abcdef", rng.choice((24, 32, 40, 64))) for _ in range(drawn)]
    hashes = [x.upper() if k % 4 == 1 else "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:32])) if k % 4 == 2 and len(x) >= 32 else x for k, x in enumerate(hexes)]
    words = found[ORDINARY] or ["the", "name", "value"]
    pick = lambda: rng.choice(words)
    forms = (
        lambda ws: "_".join(ws).lower(),
        lambda ws: "-".join(ws).lower(),
        lambda ws: "/".join(ws),
        lambda ws: ws[0].lower() + "".join(w.title() for w in ws[1:]),
        lambda ws: "".join(w.title() for w in ws),
        lambda ws: "_".join(ws).upper(),
        lambda ws: "_".join(ws).lower() + str(rng.randint(0, 9999)),
        lambda ws: "-".join(ws).lower() + f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}",
    )
    joined = [forms[k % len(forms)]([pick() for _ in range(rng.randint(2, 6))]) for k in range(drawn)]
    rulers = [chr(c) * 40 for c in ALPHABET]
    rows = [(x, label) for label, xs in ((ORDINARY, [*words, *joined, *rulers]), (RANDOM, [*found[RANDOM], *keys]), (HASH, [*found[HASH], *hashes])) for x in xs]
    return docs.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["string", "label"]), "string string, label int")


def train_from_documents(docs: DataFrame, text: str = "text") -> Models:
    return train(labelled_samples(docs, text))


def stretches(part: bytes, models: Models, least: float) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that look random, from left to right."""
    found = []
    gains = (models.ratios(part) - least).tolist()
    at, n = 0, len(gains)
    while at < n:
        total = best = 0.0
        end = begin = at
        while at < n:
            total += gains[at]
            at += 1
            if total >= best:
                best, end = total, at
            elif total < 0 and best == 0.0 or total < best - DROP:
                break
        if end - begin + 1 < MIN_CHARS - NEAR:
            at = max(end, begin + 1) if best else at
            continue
        low, high = _grown(part, begin, end + 1)
        if high - low >= MIN_CHARS and models.ratios(part[low:high]).mean() >= least and (HASH not in models.logs or models.ratios(part[low:high], HASH).mean() >= 0):
            found.append((low, high))
        at = max(end, high - 1)
    return found


def _grown(part: bytes, low: int, high: int) -> tuple[int, int]:
    """The stretch up to the joints or ends around it, if they are near; joints at its ends left out."""
    joint = b"/_-="

    def stripped(low: int, high: int) -> tuple[int, int]:
        while low < high and part[low] in joint:
            low += 1
        while low < high and part[high - 1] in b"/_-":
            high -= 1
        return low, high

    low, high = stripped(low, high)
    for k in range(low, max(-1, low - NEAR - 1), -1):
        if k == 0 or part[k - 1] in joint:
            low = k
            break
    for k in range(high, min(len(part), high + NEAR) + 1):
        if k == len(part) or part[k] in joint:
            high = k
            break
    return stripped(low, high)


def markov_spans(text: bytes, taken: list[tuple[int, int, int]], models: Models, least: float) -> list[tuple[int, int, int]]:
    """The random stretches of runs outside the spans of `taken` (sorted by start)."""
    free = bytearray(text)
    for start, _, end in taken:
        free[start:end] = b" " * (end - start)
    found = []
    for m in RUN.finditer(free):
        found += [(m.start() + a, 3, m.start() + b) for a, b in stretches(m[0], models, least)]
    return found


def scan(docs: DataFrame, models: Models, id_column: str = "doc_id", text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """Returns id and `found`: array of (kind, start, end), by start and then in the order of KINDS."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[id_column], T.StructField("found", T.ArrayType(span))])
    # pairs of symbols are few, so the models travel with the task

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for _, _, at, raw in common.blocks(common.column(batch, text)):
            data = raw.tobytes()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                row = data[a:b]
                base = base_spans(row)
                spans = sorted(base + markov_spans(row, base, models, min_ratio))
                if spans and not row.isascii():
                    place = np.cumsum((np.frombuffer(row + b"\0", np.uint8) & 0xC0) != 0x80) - 1  # code points before each byte
                    spans = [(int(place[s]), k, int(place[e])) for s, k, e in spans]
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([common.column(batch, id_column), pa.array(found, kind)], names=schema.names)

    return common.arrow_map(docs.select(id_column, text), run, schema)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans, with Spark's own functions."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_column,
        *(count(k) for k in KINDS[:3]),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
