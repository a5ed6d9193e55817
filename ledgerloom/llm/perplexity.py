"""Quality rules: base counts, and bands of n-gram perplexity under a modified Kneser-Ney model.

The model is over characters, in n-grams of order 5, counted by Spark over all documents. A character is a symbol of 12 bits:
itself below U+0C00 (digits are one), a hash beyond, so an n-gram is a hash of 60 bits, its suffix and its context are parts of
it, and discounts, continuation counts, contexts and interpolation are aggregations and joins by them. Every occurrence
counts, and no n-gram is left out. The model is, by order, a table of n-grams with their log-probabilities and one of contexts
with their log back-off weights, in whole millionths.

What tasks get are these tables as sorted arrays of hashes with an index of their top bits, up to `MODEL_ROWS` rows. A larger model sends its most frequent
n-grams of order 5 in as many rows; characters whose n-gram isn't among them are looked up in the full tables by joins, once for each
distinct n-gram. So the model grows with the corpus, and scores don't depend on what is sent.

The score is the log-perplexity per letter, in nats: the negative log-probability of all characters over the number of letters (1
at least), so predictable rows of signs don't make a text look fluent. Its median and interquartile range over all documents
of a language give that language's band, [median - BELOW * IQR, median + ABOVE * IQR]; IQR counts as `MIN_IQR` at least. As
the mean over few letters varies more, a document's distance from the median shrinks by sqrt(n / (n + SHRINK)) for n words. What then lies
outside the band is rejected. Null languages form one of their own.

Null, empty and blank texts have no words, fail the base rules and don't count for the bands. Repeated rows
count again. Extra columns are ignored.
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

ORDER, BITS, LETTERS = 5, 12, 0xC00
#: Rows of the model (16 bytes each) that are sent to all tasks; n-grams that a task holds before it hands its counts on.
MODEL_ROWS, TASK_GRAMS = 1 << 22, 1 << 21
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
BELOW, ABOVE, MIN_IQR, SHRINK = 6.0, 3.5, 0.01, 30

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Of each code point the symbol, and whether it is a letter; those beyond the first three planes count as letters.
_POINTS = np.arange(0x110000, dtype=np.int64)
TO_SYMBOL = np.where(_POINTS < LETTERS, _POINTS, LETTERS + (_POINTS * 0x9E3779B1 >> 7) % ((1 << BITS) - LETTERS))
TO_SYMBOL[48:58] = 48
LETTER = np.ones(0x110000, bool)
LETTER[:0x30000] = np.fromiter((chr(k).isalpha() for k in range(0x30000)), bool, 0x30000)


def symbols(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a block's characters, whether each is a letter, and the first of each row."""
    places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    c = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    return TO_SYMBOL[c], LETTER[c], places


def gram_codes(first: np.ndarray, c: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The code of the n-gram that ends at each symbol; a row is preceded by symbols 0."""
    codes = c.copy()
    for k in range(1, order):
        codes[k:] |= c[:-k] << (BITS * k)
    for k in range(order - 1):  # the first symbols of a row have nothing of the row before
        at = first[:-1] + k
        at = at[at < first[1:]]
        codes[at] &= (1 << BITS * (k + 1)) - 1
    return codes


def count_grams(docs: DataFrame, text: str) -> DataFrame:
    """(code, n): how often each n-gram occurs in all texts; tasks add up what they can before the shuffle."""

    def rows(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, at, raw in common.blocks(common.column(batch, text), 4 << 20):
                c, _, first = symbols(at, raw)
                found, times = np.unique(gram_codes(first, c), return_counts=True)
                codes, n = added(np.concatenate([codes, found]), np.concatenate([n, times]))
                if len(codes) > TASK_GRAMS:
                    yield from rows(codes, n)
                    codes, n = codes[:0], n[:0]
        yield from rows(codes, n)

    return docs.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their numbers."""
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(n, starts)


def _suffix(code: Column, order: int) -> Column:
    """The last order - 1 symbols of an n-gram."""
    return code.bitwiseAND((1 << BITS * (order - 1)) - 1)


def _context(code: Column) -> Column:
    return F.shiftright(code, BITS)


#: Logarithms are whole millionths of a nat, so their sums are the same in any order and by every way.
UNIT = 1_000_000
UNKNOWN, UNIFORM = 1, round(-BITS * float(np.log(2.0)) * UNIT)


def _log(p: Column) -> Column:
    return F.round(F.log(p) * UNIT).cast("int")


@dataclass
class Model:
    """By order 1 to ORDER: grams (code, n, p, logp) and contexts (ctx, weight), which is the logarithm of what they leave to the order below."""

    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]

    def resolve(self, codes: DataFrame) -> DataFrame:
        """(code, logp) of distinct n-grams (code), by joins: the longest known suffix, and the weights of the contexts passed."""
        left = codes.select("code", F.col("code").alias("rest"), F.lit(0).cast("long").alias("sum"))
        done = []
        for k in range(ORDER, 0, -1):
            known = left.join(self.grams[k].select(F.col("code").alias("rest"), "logp"), "rest", "left")
            known = common.saved(known)
            done.append(known.where("logp is not null").select("code", (F.col("sum") + F.col("logp")).alias("logp")))
            missed = known.where("logp is null").withColumn("ctx", _context(F.col("rest"))).join(self.contexts[k], "ctx", "left")
            left = missed.select("code", _suffix(F.col("rest"), k).alias("rest"), (F.col("sum") + F.coalesce("weight", F.lit(0))).alias("sum"))
        out = left.select("code", (F.col("sum") + UNIFORM).alias("logp"))
        for part in done:
            out = out.unionByName(part)
        return out


def discounts(grams: DataFrame) -> list[float]:
    """By count 1, 2 and 3 or more (Chen and Goodman), from the numbers of n-grams counted 1 to 4 times."""
    row = grams.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [0, *(max(x or 0, 1) for x in row)]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.1) for k in (1, 2, 3)]


def train(docs: DataFrame, text: str = "text") -> Model:
    counted = common.saved(count_grams(docs, text))
    counts = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        counts[k] = common.saved(counts[k + 1].groupBy(_suffix(F.col("code"), k + 1).alias("code")).agg(F.count("*").alias("n")))
    model = Model({}, {})
    for k in range(1, ORDER + 1):
        one, two, more = discounts(counts[k])
        cut = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        rows = counts[k].select("code", "n", cut.alias("cut"), _context(F.col("code")).alias("ctx"))
        totals = common.saved(rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass")))
        below = F.lit(1.0 / (1 << BITS)) if k == 1 else F.col("below")
        joined = rows.join(totals, "ctx")
        if k > 1:
            lower = model.grams[k - 1].select(F.col("code").alias("rest"), F.col("p").alias("below"))
            joined = joined.withColumn("rest", _suffix(F.col("code"), k)).join(lower, "rest")
        p = (F.col("n") - F.col("cut") + F.col("mass") * below) / F.col("total")
        model.grams[k] = common.saved(joined.select("code", "n", p.alias("p"), _log(p).alias("logp")))
        model.contexts[k] = totals.select("ctx", _log(F.col("mass") / F.col("total")).alias("weight"))
    return model


_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class HashArray:
    """Codes as hashes in ascending order with their numbers; `starts` is the first of each value of the top bits."""

    hashes: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    shift: int

    @classmethod
    def of(cls, codes: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = codes.astype(np.uint64) * _MIX
        order = np.argsort(hashes)
        bits = max(4, len(codes).bit_length() + 1)
        firsts = np.arange((1 << bits) + 1, dtype=np.uint64)
        hashes = hashes[order]
        starts = np.searchsorted(hashes >> np.uint64(64 - bits), firsts).astype(np.int32)
        return cls(hashes, values[order].astype(np.int32), starts, 64 - bits)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the wanted codes are there, the values of these)."""
        known = np.zeros(len(wanted), bool)
        if not len(self.hashes) or not len(wanted):
            return known, self.values[:0]
        h = wanted.astype(np.uint64) * _MIX
        top = (h >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        place = np.zeros(len(wanted), np.int32)
        rest = np.flatnonzero(at < end)
        while len(rest):
            here = at[rest]
            same = self.hashes[here] == h[rest]
            hit = rest[same]
            known[hit], place[hit] = True, here[same]
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return known, self.values[place[known]]


@dataclass
class Arrays:
    """The n-grams and contexts of each order in hash arrays; `whole` if nothing was left out."""

    whole: bool
    grams: dict[int, HashArray]
    contexts: dict[int, HashArray]

    @classmethod
    def of(cls, model: Model, rows: int) -> Arrays:
        """All tables, if they have `rows` rows at most, else the most frequent n-grams of the highest order."""
        size = sum(x.count() for x in (*model.grams.values(), *model.contexts.values()))

        def pull(df: DataFrame, key: str, value: str) -> HashArray:
            t = df.select(key, value).toArrow()
            return HashArray.of(t[key].to_numpy(), t[value].to_numpy())

        if size <= rows:
            return cls(True, {k: pull(x, "code", "logp") for k, x in model.grams.items()}, {k: pull(x, "ctx", "weight") for k, x in model.contexts.items()})
        return cls(False, {ORDER: pull(model.grams[ORDER].orderBy(F.desc("n"), "code").limit(rows), "code", "logp")}, {})

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Of n-grams, in units; UNKNOWN where the arrays don't tell."""
        out = np.zeros(len(codes), np.int64)
        left, rest = np.arange(len(codes)), codes
        for k in range(ORDER, 0, -1):
            known, value = self.grams[k].find(rest)
            out[left[known]] += value
            left, rest = left[~known], rest[~known]
            if not self.whole:
                out[left] = UNKNOWN
                return out
            seen, weight = self.contexts[k].find(rest >> BITS)
            out[left[seen]] += weight
            rest = rest & ((1 << BITS * (k - 1)) - 1)
        out[left] += UNIFORM
        return out


def _covered(runs: np.ndarray) -> int:
    """Words in windows (given by their hashes, one for each start) that the text has twice or more."""
    order = np.sort(runs)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    twice = np.isin(runs, order[1:][same])
    edge = np.zeros(len(runs) + WINDOW, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _repeated_lines(row: bytes) -> int:
    lines = row.split(b"\n")
    if len(lines) < 2:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line and not line.isspace():
            seen.add(line)
    return n


def measure(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", lang: str = "lang", rows: int | None = None) -> DataFrame:
    """Base counts and `score` of every text (null without words)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters")
    fields = [docs.schema[id_column], T.StructField("lang", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)]
    schema = T.StructType([*fields, T.StructField("sum", T.LongType()), T.StructField("row", T.LongType()), T.StructField("missing", T.ArrayType(T.LongType()))])
    arrays = Arrays.of(model, MODEL_ROWS if rows is None else rows)
    sent = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, at, raw in common.blocks(common.column(batch, text)):
                starts, ends, first = common.word_bounds(at, raw)
                runs = common.run_hashes(common.span_hashes(raw, starts, ends), WINDOW)
                sums = lambda x, at=at: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
                data = raw.tobytes()
                bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                words = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                n_words = np.diff(first)
                c, letters, begin = symbols(at, raw)
                codes = gram_codes(begin, c)
                logs = sent.value.log_probabilities(codes)
                lacks = np.flatnonzero(logs == UNKNOWN)
                logs[lacks] = 0
                parts = np.searchsorted(lacks, begin).astype(np.int32)
                values = [
                    n_words,
                    sums(~common.SPACE[raw] & ((raw & 0xC0) != 0x80)),
                    sums(SYMBOL[raw]),
                    [_repeated_lines(data[a:b]) for a, b in bounds],
                    [_covered(runs[a : b - WINDOW + 1]) if b - a > WINDOW else 0 for a, b in words],
                    sums(letters, begin),
                ]
                part = batch.slice(lo, hi - lo)
                made = [common.column(part, id_column), common.column(part, lang), *(pa.array(np.asarray(v).astype(np.int64)) for v in values)]
                made += [pa.array(sums(logs, begin)), pa.array(np.arange(row, row + hi - lo)), pa.ListArray.from_arrays(pa.array(parts), pa.array(codes[lacks]))]
                row += hi - lo
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    measured = common.saved(docs.select(id_column, F.col(lang).cast("string").alias(lang), text).mapInArrow(run, schema), "measured")
    if not arrays.whole:
        lacks = common.saved(measured.select("row", F.explode("missing").alias("code")).groupBy("row", "code").agg(F.count("*").alias("n")))
        found = model.resolve(lacks.select("code").distinct())
        more = lacks.join(found, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("more"))
        measured = measured.join(more, "row", "left").withColumn("sum", F.col("sum") + F.coalesce("more", F.lit(0)))
    return measured.withColumn("score", F.when(F.col("n_words") > 0, -F.col("sum") / (UNIT * F.greatest("n_letters", F.lit(1))))).select(*(f.name for f in fields), "score")


def judge(measured: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Adds base_failed, the band of the language (lower, upper), the shrunk score and `kept`."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = measured.withColumn("base_failed", failed).withColumn("lang", F.coalesce("lang", F.lit("")))
    quartiles = rows.where("n_words > 0").groupBy("lang").agg(F.percentile_approx("score", [0.25, 0.5, 0.75], 10000).alias("q"))
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(MIN_IQR))
    middle = F.col("q")[1]
    bands = quartiles.select("lang", middle.alias("middle"), (middle - below * spread).alias("lower"), (middle + above * spread).alias("upper"))
    bands = common.saved(bands)  # a row for each language, so that Spark knows the size and need not deal rows out by language
    n = F.col("n_words")
    shrunk = F.col("middle") + (F.col("score") - F.col("middle")) * F.sqrt(n / (n + SHRINK))
    judged = rows.join(bands, "lang", "left").withColumn("shrunk", shrunk)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("shrunk").between(F.col("lower"), F.col("upper")), F.lit(False)))


def filter_quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    with common.Scratch() as run:
        measured = run.result(measure(docs, train(docs, text), id_column, text, lang), "measured")
    return judge(measured)
