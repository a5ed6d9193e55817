"""Periodic runs: stretches of words that repeat with a period, found by harmonic grid probing.

A run is a stretch of words with smallest period q (words q apart are identical), of at least max(min_words, 2 * q) words, that
no neighbouring word extends. Its words after the first q are repetitions.

A stretch of 2 * p words or more with period p has equal words at some grid points j * p and (j + 1) * p, so probing the multiples of
each p finds them all: about n log n probes for n words. Points whose words agree are extended to both sides by comparing
chunks of the array, each only to its neighbours on the grid; neighbours that meet are of one stretch. Periods are probed by octaves
[2^k, 2^(k+1)). No period of an octave divides another of it, so points within a run found earlier whose period divides p are
skipped: what they would find is that run again.

Many texts are probed at once, `common.BLOCK_BYTES` of them at a time; a longer text is one block, and an octave never takes more than
`PROBES` probes or so at a time. A null or empty text, or one of white space only, has no words and no runs. Repeated rows and null ids are
rows like others; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_WORDS = 12
#: Probes and compared words that are in memory at a time.
PROBES, CELLS = 1 << 21, 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _agreeing(words: np.ndarray, at: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many of the `limit` places at, at + step, ... hold the word that stands `period` later, up to the first that doesn't."""
    found = np.zeros(len(at), np.int64)
    live, chunk = np.flatnonzero(limit > 0), 8
    while len(live):
        after = []
        for some in np.array_split(live, -(-len(live) * chunk // CELLS)):
            ahead = np.minimum(np.arange(chunk), (limit[some] - found[some] - 1)[:, None])  # past the limit the last one again
            here = at[some, None] + step * (found[some, None] + ahead)
            same = words[here] == words[here + period[some, None]]
            ended = ~same.all(1)
            count = np.where(ended, same.argmin(1), chunk)
            found[some] = np.minimum(found[some] + count, limit[some])
            after.append(some[~ended & (found[some] < limit[some])])
        live, chunk = np.concatenate(after), min(chunk * 4, 1 << 14)
    return found


def _within(runs: dict[int, np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a run whose period divides the given one covers both the place and the place a period later."""
    inside = np.zeros(len(at), bool)
    for q, spans in runs.items():
        some = np.flatnonzero((period % q == 0) & ~inside)
        k = np.searchsorted(spans[:, 0], at[some], "right") - 1  # runs of one period end in the order in which they start
        inside[some] = (k >= 0) & (spans[np.maximum(k, 0), 1] > at[some] + period[some])
    return inside


def _probes(first: np.ndarray, size: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the grid points of the periods low to 2 * low - 1, in order."""
    texts = np.flatnonzero(size >= 2 * low)
    periods = np.minimum(2 * low - 1, size[texts] // 2) - low + 1
    text = np.repeat(texts, periods)
    period = low + np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)
    points = (size[text] - 1) // period
    before = np.cumsum(points) - points
    cuts = np.searchsorted(before, np.arange(0, int(points.sum()), PROBES), "left") if len(text) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(text)], strict=True):
        n = points[lo:hi]
        t, p = np.repeat(text[lo:hi], n), np.repeat(period[lo:hi], n)
        yield t, p, first[t] + p * (np.arange(len(t)) - np.repeat(before[lo:hi] - before[lo], n))


def find(words: np.ndarray, first: np.ndarray, size: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period. words: numbers of the words of all texts, one text after
    the other; first, size: where each text's words start and how many they are. No run reaches into the next text."""
    runs: dict[int, np.ndarray] = {}
    low = 1
    while 2 * low <= size.max(initial=0):
        fresh = []
        for text, period, at in _probes(first, size, low):
            hit = np.flatnonzero(words[at] == words[at + period])
            text, period, at = text[hit], period[hit], at[hit]
            new = np.flatnonzero(~_within(runs, at, period))
            text, period, at = text[new], period[new], at[new]
            ahead = _agreeing(words, at, period, np.minimum(period, first[text] + size[text] - period - at), 1)
            back = _agreeing(words, at - 1, period, np.minimum(period - 1, at - first[text]), -1)
            joined = (ahead[:-1] == period[:-1]) & (at[1:] == at[:-1] + period[:-1]) & (period[1:] == period[:-1]) & (text[1:] == text[:-1])
            head, tail = np.flatnonzero(np.append(True, ~joined))[: len(at)], np.flatnonzero(np.append(~joined, True))[: len(at)]
            start, end, p = at[head] - back[head], at[tail] + ahead[tail] + period[tail], period[head]
            long = end - start >= np.maximum(min_words, 2 * p)
            fresh.append(np.stack([start[long], end[long], p[long]], 1))
        got = np.concatenate(fresh) if fresh else np.zeros((0, 3), np.int64)
        for p in np.unique(got[:, 2]):
            spans = got[got[:, 2] == p]
            runs[int(p)] = spans[np.argsort(spans[:, 0])]
        low *= 2
    found = np.concatenate([*runs.values(), np.zeros((0, 3), np.int64)])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    split = [t.split() for t in texts]  # bytes.split takes just [\x20\x09-\x0D]
    size = np.array([len(ws) for ws in split], np.int64)
    words = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
    return split, words, np.cumsum(size) - size, size


def scan(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with their runs (an array of start, length and period by start, then period; word numbers from 0) and their words
    without the repetitions, joined by one space. Columns that have these names are replaced."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in (runs.lower(), collapsed.lower())]
    schema = T.StructType([*kept, T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())])

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, _, _ in common.blocks(common.column(batch, text)):
            rows = batch.slice(lo, hi - lo)
            split, words, first, size = _numbered([t.encode() for t in common.strings(common.column(rows, text))])
            found = find(words, first, size, min_words)
            owner = np.searchsorted(first + size, found[:, 0], "right")
            own = np.searchsorted(owner, np.arange(len(split) + 1))
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, found[:, 0] + found[:, 2], 1)
            np.add.at(depth, found[:, 1], -1)
            keep = np.cumsum(depth[:-1]) == 0
            listed, short = [], []
            for k, ws in enumerate(split):
                mine = found[own[k] : own[k + 1]]
                listed.append([{"start": int(s - first[k]), "length": int(e - s), "period": int(p)} for s, e, p in mine])
                if len(mine):
                    ws = [ws[i] for i in np.flatnonzero(keep[first[k] : first[k] + size[k]])]
                short.append(b" ".join(ws).decode())
            kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))
            columns = [common.column(rows, f.name) for f in kept] + [pa.array(listed, kind), pa.array(short, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return common.arrow_map(docs.select(*[F.col(f"`{f.name}`") for f in kept]), over, schema)


def digest(scanned: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """doc_id, the number of runs, the longest one (ties: smallest start, then period) and digests of the runs and of the rest."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    return scanned.withColumn("_best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(collapsed).cast("binary"), 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents; those with a checksum divisible by 10 get words that repeat from some place on, as the query's
    contract asks: with h the crc32 of the id, g = h div 10 and n words, each word i from a = g mod n on becomes word a + (i - a) mod p,
    p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums, texts = common.column(batch, "h").to_pylist(), common.column(batch, "text").to_pylist()
        for k, h in enumerate(sums):
            if h is not None and h % 10 == 0 and (ws := (texts[k] or "").encode().split()):
                g, n = h // 10, len(ws)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[k] = b" ".join(ws[:a] + (ws[a : a + p] * -(-(n - a) // p))[: n - a]).decode()
        yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    given = docs.select("doc_id", "text", common.crc32_of_id("doc_id").alias("h"))
    return common.arrow_map(given, over, T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType())]))
