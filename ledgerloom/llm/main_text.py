"""Main text of web pages by wrapper induction: pages of a host are aligned with a wrapper of theirs by simple tree matching.

1. The `REFERENCES` pages of a host with the smallest hashes of their ids among those with html are aligned with each other; the tree that holds
   the blocks of all is the host's wrapper, so blocks that some pages lack have their slots, too.
2. Every page of the host is aligned with it. A text of the wrapper that 9 of 10 pages have in the same slot is constant: template. Pages
   that share half of their text with the references or more say nothing about that (copies of an article don't make it a template), and less
   than `MIN_PAGES` others don't decide.
3. Every page is aligned again. Of its article (else its main part, else the page), blocks that stand in a constant slot with the constant's text
   are template; what varies is content. Menus, headers, footers, sidebars, notices, adverts, forms and comments are known by their
   elements, roles and names, in whatever slot they stand. A header within the article is part of it.

Blocks are joined by a line feed; white space in a block, line breaks among it, is one space; nothing is capped. Null or empty html has no
text, a page without a host no wrapper. Repeated rows count again. Extra columns stay; a column of the result's name is replaced.

Counts leave tasks as one row for each text of a wrapper. Wrappers go to all tasks up to `WRAPPER_BYTES` of references; beyond it pages
are shuffled to their wrapper by host, in parts of some `PART_PAGES` pages, each in a stream behind a copy of the wrapper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, dom
from .url_filter import host_of

#: Pages that make a wrapper.
REFERENCES = 5
#: Pages that decide on a constant at least, the share of them that have it, and the share of a page's text that makes it a copy.
MIN_PAGES, CONSTANT, COPY = 8, 0.9, 0.5
#: Keys of references (some 40 bytes each) that are sent to all tasks.
KEYS = 500_000
#: Bytes of references and numbers that are sent to all tasks; pages that meet a copy of their wrapper; bytes of wrappers that a task keeps; counts it holds.
WRAPPER_BYTES, PART_PAGES, KEPT_BYTES, HELD = 32 << 20, 20_000, 8 << 20, 200_000


class _Wrappers:
    """The wrappers of a task, parsed when a page needs them."""

    def __init__(self):
        self.parsed: dict[str, tuple[dom.Wrapper, frozenset[int]]] = {}
        self.bytes = 0

    def of(self, host: str, references: list[str], constant: list[int] | None) -> tuple[dom.Wrapper, frozenset[int]]:
        if host not in self.parsed:
            if self.bytes > KEPT_BYTES:
                self.parsed.clear()
                self.bytes = 0
            self.parsed[host] = dom.Wrapper(references), frozenset(constant or ())
            self.bytes += sum(map(len, references))
        return self.parsed[host]


def _read(html: str, wrapper: dom.Wrapper | None) -> tuple[list[dom.Node], dict[int, dom.Slot]]:
    root = dom.parse(html)
    leaves = dom.content(root)
    return leaves, wrapper.align(root) if wrapper and leaves else {}


def _text(html: str, wrapper: dom.Wrapper | None, constant: frozenset[int]) -> str:
    leaves, slots = _read(html, wrapper if constant else None)
    return "\n".join(x.text for x in leaves if not (id(x) in slots and slots[id(x)].texts.get(x.text) in constant))


class _Counts:
    """How many pages of a host have a leaf in a slot, and how many have a wrapper's text there."""

    def __init__(self):
        self.held: dict[str, tuple[dom.Wrapper, np.ndarray, np.ndarray]] = {}
        self.size = 0

    def add(self, host: str, html: str, wrapper: dom.Wrapper) -> None:
        leaves, slots = _read(html, wrapper)
        numbers = [slots[id(x)].texts.get(x.text) if id(x) in slots else None for x in leaves]
        total = sum(len(x.text) for x in leaves)
        if sum(len(x.text) for x, n in zip(leaves, numbers, strict=True) if n is not None) >= COPY * total:
            return
        if host not in self.held:
            self.held[host] = wrapper, np.zeros(wrapper.slots, np.int64), np.zeros(len(wrapper.owner), np.int64)
            self.size += len(wrapper.owner)
        _, there, same = self.held[host]
        there[list({slots[id(x)].number for x in leaves if id(x) in slots})] += 1
        same[list({n for n in numbers if n is not None})] += 1

    def flush(self) -> pa.RecordBatch:
        parts = []
        for host, (wrapper, there, same) in self.held.items():
            some = np.flatnonzero(same)
            parts.append((np.full(len(some), host, object), some, there[np.array(wrapper.owner, int)[some]] if len(some) else some, same[some]))
        self.__init__()
        host, number, pages, equal = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(number, pa.int32()), pa.array(pages), pa.array(equal)], names=["host", "number", "pages", "same"])


def _with_wrappers(pages: DataFrame, host: Column, wrappers: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow of the pages with fn(batches), which takes pairs (batch, wrapper of a row's host: host -> (references, constant))."""
    size = wrappers.agg(F.sum(F.length(F.array_join("references", "")) + F.length("host") + 4 * F.size("constant"))).first()[0] or 0
    named = pages.withColumn(at := common.unused(pages, "_host"), host)
    if size <= WRAPPER_BYTES:
        held = pages.sparkSession.sparkContext.broadcast({r.host: (list(r.references), list(r.constant)) for r in wrappers.collect()})
        return named.mapInArrow(lambda batches: fn(((b, held.value.get) for b in batches), at), schema)
    # each wrapper is a row before the pages of its host, or before each part of them
    count = named.groupBy(F.col(at).alias("host")).count()
    parts = common.saved(wrappers.join(count.withColumn("parts", (F.col("count") / PART_PAGES + 1).cast("int")), "host"), "wrappers")
    split = parts.where("parts > 1").select(F.col("host").alias(at), "parts")  # a host with more than PART_PAGES pages each
    part, first, references, constant = (common.unused(named, c) for c in ("_part", "_first", "_references", "_constant"))
    named = named.join(F.broadcast(split) if split.count() <= common.HEAVY_KEYS else split, at, "left")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), F.coalesce("parts", F.lit(1)))
    given = named.select(*pages.columns, at, salt.cast("int").alias(part), F.lit(1).alias(first))
    ahead = parts.select(F.col("host").alias(at), F.explode(F.expr("sequence(0, parts - 1)")).alias(part), F.lit(0).alias(first), F.col("references").alias(references), F.col("constant").alias(constant))
    rows = given.unionByName(ahead, allowMissingColumns=True).repartition(at, part).sortWithinPartitions(at, part, first)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator:
        now: dict[str, tuple[list[str], list[int]]] = {}
        for batch in batches:
            kinds, known = common.column(batch, first).to_pylist(), dict(now)
            for k, kind in enumerate(kinds):
                if kind == 0:
                    name = common.column(batch, at)[k].as_py()
                    known[name] = now[name] = common.column(batch, references)[k].as_py(), common.column(batch, constant)[k].as_py()
                    now = {name: now[name]}  # only the last one's pages may go on in the next batch
            yield batch.filter(pa.array([k == 1 for k in kinds])), known.get

    return rows.mapInArrow(lambda batches: fn(stream(batches), at), schema)


def learn(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(host, references, constant): the pages that make each host's wrapper, and the numbers of its texts that are template; saved in the shared folder."""
    named = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(key).alias("key"), F.col(html).alias("html")).where("host <> '' and html <> ''")
    nth = F.row_number().over(Window.partitionBy("host").orderBy("key"))
    least = common.saved(named.select("host", "key").withColumn("nth", nth).where(F.col("nth") <= REFERENCES).select("host", "key").distinct(), "reference-keys")
    least = F.broadcast(least) if least.count() <= KEYS else least
    each = named.join(least, ["host", "key"]).groupBy("host", "key").agg(F.min("html").alias("html"))  # equal keys: the smallest html of them
    chosen = common.saved(each.groupBy("host").agg(F.sort_array(F.collect_list("html")).alias("references")), "references")
    given = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    counts = _with_wrappers(given, host_of(F.col("url")), chosen.withColumn("constant", F.array().cast("array<int>")), _count, "host string, number int, pages long, same long")
    constant = counts.groupBy("host", "number").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same")).where(f"pages >= {MIN_PAGES} and same >= {CONSTANT} * pages")
    listed = constant.groupBy("host").agg(F.sort_array(F.collect_list("number")).alias("constant"))  # texts of one page
    return common.saved(chosen.join(listed, "host", "left").withColumn("constant", F.coalesce("constant", F.array().cast("array<int>"))), "wrappers")


def _count(batches: Iterator, at: str) -> Iterator[pa.RecordBatch]:
    wrappers, counts = _Wrappers(), _Counts()
    for batch, known in batches:
        for host, html in zip(common.column(batch, at).to_pylist(), common.column(batch, "html").to_pylist(), strict=True):
            if html and (found := known(host)):
                counts.add(host, html, wrappers.of(host, *found)[0])
                if counts.size > HELD:
                    yield counts.flush()
    if counts.held:
        yield counts.flush()


def extract(pages: DataFrame, wrappers: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """The pages with their main text. No row is null in it."""
    kept = [f for f in pages.schema.fields if f.name.lower() != out.lower()]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def over(batches: Iterator, at: str) -> Iterator[pa.RecordBatch]:
        parsed = _Wrappers()
        for batch, known in batches:
            texts = []
            for host, page in zip(common.column(batch, at).to_pylist(), common.column(batch, html).to_pylist(), strict=True):
                found = known(host) if page else None
                texts.append(_text(page or "", *(parsed.of(host, *found) if found else (None, frozenset()))))
            yield pa.RecordBatch.from_arrays([*(common.column(batch, f.name) for f in kept), pa.array(texts, pa.string())], names=schema.names)

    return _with_wrappers(pages, host_of(F.col(url)), wrappers, over, schema)
