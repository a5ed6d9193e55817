"""Source divergence audit: how the words of a source differ from those of its language and of the other sources of that language.

Terms are runs of ASCII letters (A-Z lower-cased) and other characters beyond ASCII. Each language keeps the terms that at least `min_docs` of
its documents hold; V is their number. In a group (language, source), and in a language, each of them has p = 1 + floor(10^9 * (count + 2) / (N + 2 V)),
N being the group's count of kept terms, and two values differ by f(p, q) = floor((p - q)^2 / (p + q)). All arithmetic is in whole numbers.

* `terms`: the k terms of each group that stand out most from their language (p > q). A group's terms lie in buckets by their count there. For p > q
  f grows with p and falls with q, so f of the largest p and the smallest q of a bucket bounds all its terms. Buckets are evaluated best first: those
  with the largest bounds until they hold k terms, which give a k-th value, then those whose bound isn't strictly below it; no other is looked at.
* `pairs`: the sum of f over all kept terms for each two sources of a language. Terms that both have are added up from postings (the sources of a term, one
  row a term); what a term adds that one of them has, or neither, depends on its count there only, so histograms of counts give the rest.

Texts are counted in their tasks and leave them as one row for each group and term of a batch of texts, so a source or a word with a third of all rows
meets in no task as more than a row from each. Null text, lang and source count as ''. Each row is a document. Groups without terms have their pairs,
with value 0 where the language keeps no term. Extra columns are ignored. Nothing is collected; groups go to all tasks up to `GROUPS` of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS, TOP = 10, 10
#: Buckets for each doubling of a count.
BUCKETS = 4
#: Groups (some 100 bytes each) that are sent to all tasks; counted terms that a task holds; pairs of sources summed up at a time.
GROUPS, HELD, PAIRS = 200_000, 400_000, 1 << 20

#: Bytes of a term as themselves, A-Z as a-z, others as a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, as partial sums; a row with term '' for each group."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, source, term, n, docs[term]) for (lang, source), (count, docs) in held.items() for term, n in count.items()]
            rows += [(lang, source, b"", 0, 0) for lang, source in held]
            held.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            columns[2] = columns[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(common.strings(common.column(batch, c)) for c in ("lang", "source", "text")), strict=True):
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(count)
                own = Counter(text.encode().translate(_TERM).split())
                count.update(own)
                docs.update(own.keys())
                size += len(count)
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    given = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return given.mapInArrow(over, "lang string, source string, term string, n long, d long")


def _p(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 kept)); decimals, as counts of large corpora times 10^9 pass 2^63."""
    return F.expr(f"1L + cast((cast({count} + 2 as decimal(19, 0)) * 1000000000BD) div cast({total} + 2 * {kept} as decimal(19, 0)) as long)")


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); at most 10^9 + 1 each, so the square fits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


class Audit:
    """The counts of a table of documents, saved in the shared folder; `terms` and `pairs` read them."""

    def __init__(self, postings: DataFrame, groups: DataFrame, top: int):
        self.postings, self.groups, self.top = postings, groups, top
        self.many = groups.count() > GROUPS

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> Audit:
        """Two shuffles: counts by group and term (summed up in the tasks before), then a row for each term of a language."""
        counts = _counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        listed = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("lang_d"), F.collect_list(F.struct("source", "n")).alias("postings"))
        postings = common.saved(listed.where((F.col("term") == "") | (F.col("lang_d") >= min_docs)), "audit-postings")
        each = postings.select("lang", "term", F.explode("postings").alias("x")).select("lang", "x.source", F.expr("if(term = '', 0L, 1L)").alias("size"), "x.n")
        groups = each.groupBy("lang", "source").agg(F.sum("size").alias("size"), F.sum("n").alias("total"))
        langs = postings.groupBy("lang").agg(F.sum(F.expr("if(term = '', 0L, 1L)")).alias("kept"), F.sum("lang_n").alias("lang_total"))
        known = groups.join(F.broadcast(langs) if langs.count() <= GROUPS else langs, "lang")
        # without a kept term nothing asks for a probability: any will do
        known = known.withColumn("p0", F.when(F.col("kept") > 0, _p("0L", "total", "greatest(kept, 1L)")).otherwise(1))
        return cls(postings, common.saved(known, "audit-groups"), top)

    def _with_group(self, rows: DataFrame) -> DataFrame:
        keys = ["lang", "source"]
        return common.join_once(rows, self.groups, keys, "size") if self.many else rows.join(F.broadcast(self.groups.drop("size")), keys)

    def terms(self) -> DataFrame:
        """lang, source, item, value, rank: the `top` terms of each group by value, then by their bytes."""
        each = self.postings.where("term <> ''").select("lang", "term", "lang_n", F.explode("postings").alias("x")).select("lang", "x.source", "term", "x.n", "lang_n")
        known = self._with_group(each).select("lang", "source", "term", "n", _p("n", "total", "kept").alias("p"), _p("lang_n", "lang_total", "kept").alias("q"))
        bucket = F.floor(F.log2("n") * BUCKETS).cast("int")
        rows = common.saved(known.where("p > q").withColumn("bucket", bucket), "audit-terms")
        keys = ["lang", "source", "bucket"]
        bounds = rows.groupBy(*keys).agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("size")).withColumn("bound", _f("p", "q"))
        best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
        before = F.coalesce(F.sum("size").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bounds = common.saved(bounds.withColumn("before", before).select(*keys, "bound", "before"), "audit-bounds")
        ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

        def evaluated(chosen: DataFrame) -> DataFrame:
            some = rows.join(chosen.select(*keys), keys).select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
            return some.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= self.top)

        kth = evaluated(bounds.where(F.col("before") < self.top)).where(F.col("rank") == self.top).select("lang", "source", F.col("value").alias("kth"))
        return evaluated(bounds.join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth"))

    def pairs(self) -> DataFrame:
        """lang, source, item, value, rank: every other source of the language by the sum of f, then by its bytes."""
        each = self.postings.where("term <> ''").select("lang", "term", F.explode("postings").alias("x")).select("lang", "term", "x.source", "x.n")
        known = self._with_group(each).select("lang", "term", "source", _p("n", "total", "kept").alias("p"), "p0", "kept")
        known = common.saved(known, "audit-values")
        both = known.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("x")).select("lang", "x")
        shared = both.mapInArrow(_shared, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        histogram = known.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
        ours = self.groups.select("lang", "source", "p0", "size", "kept")
        theirs = ours.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"), F.col("size").alias("o_size"))
        theirs = theirs if self.many else F.broadcast(theirs)
        one = histogram.join(theirs, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _f("p", "o0")).alias("value"))
        other = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        neither = ours.join(theirs, "lang").where("source <> item").select("lang", "source", "item", ((F.col("kept") - F.col("size") - F.col("o_size")) * _f("p0", "o0")).alias("value"))
        flipped = shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        total = neither.unionByName(one).unionByName(other).unionByName(shared).unionByName(flipped).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        return total.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources have add to their sum, over what the histograms count for each alone and for neither."""
    sums: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(*k, v) for k, v in sums.items()]
        sums.clear()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "source", "item", "value"])

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    for batch in batches:
        langs = common.column(batch, "lang").dictionary_encode()
        lists = common.column(batch, "x")
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        at = at - at[0]
        names = flat.field("source").dictionary_encode()
        name = names.indices.to_numpy().astype(np.int64)
        p, p0 = (flat.field(c).to_numpy() for c in ("p", "p0"))
        size = np.diff(at)
        last = np.repeat(at[1:], size)  # each place of a list is paired with those behind it
        behind = last - np.arange(len(name)) - 1
        upto = np.concatenate([[0], np.cumsum(behind)])
        lo = 0
        while lo < len(name):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
            a = np.repeat(np.arange(lo, hi), behind[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(upto[lo:hi] - upto[lo], behind[lo:hi])
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p[b], p0[a]) + f(p0[a], p0[b])
            lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)[a] if len(a) else a
            key = (lang * len(names.dictionary) + np.minimum(name[a], name[b])) * len(names.dictionary) + np.maximum(name[a], name[b])
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            for k, v in zip(key[order][first].tolist(), np.add.reduceat(value[order], first).tolist() if len(first) else [], strict=True):
                k, y = divmod(k, len(names.dictionary))
                g, x = divmod(k, len(names.dictionary))
                x, y = sorted((names.dictionary[x].as_py(), names.dictionary[y].as_py()))
                sums[langs.dictionary[g].as_py(), x, y] += v
            lo = hi
        if len(sums) > PAIRS:
            yield flush()
    if sums:
        yield flush()


def report(docs: DataFrame) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank. The counts saved on the way are deleted with the run around this one, or at its end."""
    with common.Scratch() as run:
        audit = Audit.build(docs)
        columns = ["lang", "source", "part", "item", "value", "rank"]
        both = [rows.withColumn("part", F.lit(part)).select(*columns) for part, rows in (("pair", audit.pairs()), ("term", audit.terms()))]
        return run.result(both[0].unionByName(both[1]), "audit-report")
