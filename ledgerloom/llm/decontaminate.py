"""Benchmark decontamination: size-partitioned MinHash containment search with Spark's own functions.

An item's set holds its distinct 5-word shingles. Items are partitioned by set size into powers of two, and each keeps its
smallest MinHash values: half of the partition's largest size and one more, or all it has. A document that contains three
quarters of an item's n shingles lacks floor(n / 4) of them at most, so of k kept values it holds k - floor(n / 4) or
more. Documents of any length are searched by looking their shingles up among the kept values, in the scan and
without a shuffle of shingles; pairs of a document and an item with fewer common values than that are dropped, the
others are verified by the containment of the shingles themselves.

Up to `BROADCAST_ROWS` kept values go to all tasks. Beyond it a bit array of 2**26 places goes there instead, and only
shingles whose place is set are joined with the kept values by a shuffle.

Words are runs of `[^\\x20\\x09-\\x0D]`, lower-cased by Spark's lower(). A text of fewer than 5 words has its whole
sequence as one shingle; null, empty and blank texts have none, contain nothing and aren't contained. Rows that
share an id are one document, as are rows with a null id and equal texts; rows of items that share an id are one item
each by text. Extra columns are ignored by `contained` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

N_WORDS, PERCENT, KEEP_PERCENT = 5, 75, 50
#: Rows that go to all tasks: kept values (50 bytes each), candidate documents, items. Beyond it they are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_ITEMS = 200_000, 20_000
#: The bit array: words of 64 bits in a row of it, and rows.
ROW_WORDS, ROWS = 512, 1 << 11


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+"), "")


def shingle_hashes(ws: Column, n: int = N_WORDS) -> Column:
    """Hashes of the shingles of an array of word hashes, with repetitions."""
    runs = F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]))
    return F.when(F.size(ws) >= n, runs).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))


def shingles(ws: Column, n: int = N_WORDS) -> Column:
    """The distinct shingles of an array of words, as text."""
    runs = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.array_distinct(F.when(F.size(ws) >= n, runs).when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>")))


def _hashed(rows: DataFrame, n: int) -> DataFrame:
    """(key columns, h): a row for each shingle of `text`, twice if repeated."""
    keys = [c for c in rows.columns if c != "text"]
    ws = rows.select(*keys, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"))
    return ws.select(*keys, F.explode(shingle_hashes(F.col("_w"), n)).alias("h"))


def sketches(items: DataFrame, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(h, item, need): the kept MinHash values of each item (item, text), and how many of them a document that contains it holds."""
    hashed = items.select("item", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"))
    sized = hashed.select("item", F.array_distinct(shingle_hashes(F.col("_w"), n)).alias("hs")).where(F.size("hs") > 0)
    size = F.size("hs")
    largest = F.pow(F.lit(2), F.ceil(F.log2(size.cast("double"))))
    lacking = F.floor(size * (100 - percent) / 100).cast("int")
    kept = F.least(size, F.greatest(F.floor(largest * KEEP_PERCENT / 100).cast("int"), lacking) + 1)
    ranked = F.array_sort(F.transform("hs", lambda h: F.struct(F.xxhash64(h, F.lit(7)).alias("r"), h.alias("h"))))
    return sized.select("item", (kept - lacking).alias("need"), F.explode(F.slice(ranked, F.lit(1), kept)).alias("s")).select(F.col("s.h").alias("h"), "item", "need").distinct()


def bit_rows(kept: DataFrame) -> DataFrame:
    """(row, words): the bit array of all kept values, ROWS rows at most of ROW_WORDS words."""
    place = kept.select(*_place(F.col("h"))).distinct()
    words = place.groupBy("row", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    listed = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return listed.select("row", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def _place(h: Column) -> list[Column]:
    bit = h.bitwiseAND(63).cast("int").alias("bit")
    word = F.shiftright(h, 6).bitwiseAND(ROW_WORDS - 1).cast("int").alias("word")
    return [F.shiftright(h, 6 + ROW_WORDS.bit_length() - 1).bitwiseAND(ROWS - 1).cast("int").alias("row"), word, bit]


def look_up(shingled: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (doc, h) joined with the kept values (h, item, need)."""
    if kept.count() <= BROADCAST_ROWS:
        return shingled.join(F.broadcast(kept), "h")
    bits = F.broadcast(common.saved(bit_rows(kept)))
    likely = shingled.select("*", *_place(F.col("h"))).join(bits, "row").where(F.getbit(F.get("words", F.col("word")), F.col("bit")) == 1)
    return likely.select("doc", "h").distinct().join(kept.hint("merge"), "h")


def _sent(rows: DataFrame, most: int) -> DataFrame:
    """Rows for the small side of a join: sent to all tasks if their count allows it."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def contained(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text", n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, item id, n_item, n_shared): the items with at least `percent` of their shingles in the document."""
    key = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    texts = docs.select(key.alias("doc"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    item = F.md5(F.concat_ws("\n", F.coalesce(F.col(item_column).cast("string"), F.lit("null")), F.col(text)).cast("binary"))
    with common.Scratch() as run:
        benchmark = common.saved(items.where(F.col(text).isNotNull()).select(item.alias("item"), F.col(item_column).alias("item_id"), F.col(text).alias("text")).distinct())
        met = candidates(texts.select("doc", "text"), common.saved(sketches(benchmark, n, percent)), n)
        by_doc = common.saved(met.groupBy("doc").agg(F.collect_list("item").alias("items")))  # of each document, so no more than items
        # words first: within one expression Spark would split the text anew for each shingle
        parsed = texts.join(_sent(by_doc, BROADCAST_ROWS), "doc").select("id", "items", words(F.col("text")).alias("_w"))
        pairs = parsed.select("id", "items", shingles(F.col("_w"), n).alias("present")).select("id", F.explode("items").alias("item"), "present")
        sets = common.saved(benchmark.select("item", "item_id", words(F.col("text")).alias("_w")).select("item", "item_id", shingles(F.col("_w"), n).alias("wanted")))
        shared = F.size(F.array_intersect("wanted", "present")).cast("long")
        checked = pairs.join(_sent(sets, BROADCAST_ITEMS), "item").select("id", "item_id", F.size("wanted").cast("long").alias("n_item"), shared.alias("n_shared"))
        hits = checked.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        found = hits.groupBy("id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
        return run.result(found).withColumnsRenamed({"id": id_column, "item_id": item_column})


def candidates(texts: DataFrame, kept: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(doc, item, hits): documents that hold as many of an item's kept values as one that contains it."""
    found = look_up(_hashed(texts, n), kept).groupBy("doc", "item").agg(F.size(F.collect_set("h")).alias("hits"), F.first("need").alias("need"))
    return found.where("hits >= need").select("doc", "item", "hits")


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that contain no item. Rows with a null id are found by their text."""
    key = common.unused(docs, "_doc")
    keyed = docs.withColumn(key, F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))))
    bad = common.saved(contained(keyed.select(key, F.col(text)), items, key, text=text, **options).select(key).distinct())
    return keyed.join(_sent(bad, BROADCAST_ROWS), key, "left_anti").select(*docs.columns)
