"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Sets are banded by size, each
band up to twice as large as the one below; a set enters its own band and, if a partner of the least
similarity may be larger than the band, the next one. A band divides the feature domain into partitions.
Two sets of one band whose symmetric difference is d agree on all but d partitions; the content of a
partition that isn't empty gives a signature, so sets with f signatures share f - d of them at least.

* Up to `EXACT_SIZE` shingles the whole domain is divided, into more partitions than the largest possible
  difference, and pairs are only dropped when they share fewer signatures than that bound: none is lost. A set
  with no more signatures than the largest difference therefore also has each single feature as a signature.
* Larger sets use a fixed slice of the domain that holds 128 to 256 of their features in expectation, in
  72 partitions. A pair at the threshold shares about 28 signatures; pairs that share fewer than three are dropped.

Equal sets become one class first. A signature's smallest class is its pivot, and each class is compared
with the pivot that it shares most signatures with. What those links connect needs no further comparison:
only signatures that still hold two components go on, and only pairs that share enough signatures of one
band. Buckets of up to `BUCKET` classes give pairs, which are counted. A larger bucket comes from a frequent
passage or a family of loose copies: classes with enough such signatures meet under as many of these, the rarest first, as
two that share enough must have one of in common (prefix filter), and are counted against each other as matrices, in blocks, and a spanning forest of the pairs that share enough leaves the task. Classes connected
by such pairs form a cluster, outside of which no class has a link to find; within it sets are compared exactly, again in
blocks, and a spanning forest of the links leaves the task. Both leave the largest component of a group out of
comparisons with itself. So no step emits pairs by the square of a group's size. Keys that hold many rows are
sent to all tasks (`common.join_once`) or salted.

Null, empty and blank texts have no shingles and link with nothing; texts of fewer words than n have their
whole sequence as one. Rows that share an id are one document. Rows whose id is null link with nothing and get a
null component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

N_WORDS, PERCENT = 5, 75
EXACT_SIZE, FIRST_BAND, BUCKET = 128, 32, 24
#: Bytes of text that are turned into sets at a time.
BLOCK_BYTES = 1 << 18
#: Classes of a block: of sets, and of lists of signatures, which are shorter.
BLOCK, SIGNATURE_BLOCK = 1000, 2000
#: Partitions of the first bands, which divide the whole domain, and of the others.
EXACT_PARTITIONS, PARTITIONS = (24, 32, 64), 72
#: Members that are compared with one copy of a pivot's text.
PIVOT_ROWS = 500
#: Low bits of a signature: the partition's number, then the band, to 31 (2**36 shingles), and a bit for single features.
PLACE_BITS, BAND_BITS, SINGLES = 7, 6, 32
#: Ids sent to all tasks to pick texts: 8 bytes each.
BROADCAST_IDS = 2_000_000


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int = N_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text in a block."""
    data = common.LOWER[data]
    starts, ends, first = common.word_bounds(offsets, data)
    words = common.span_hashes(data, starts, ends)
    runs = common.run_hashes(words, n)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            h = np.sort(runs[a : b - n + 1])
            keep = np.empty(len(h), bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            sets.append(h[keep])
        else:
            sets.append(common.run_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets


def bands(size: int, percent: int = PERCENT) -> list[int]:
    """The bands a set of this size enters; band i reaches up to FIRST_BAND * 2**i."""
    own = max(0, (size - 1).bit_length() - (FIRST_BAND - 1).bit_length())
    return [own, own + 1] if size * 100 // percent > FIRST_BAND << own else [own]


def partitions(band: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """Of a band: partitions, the largest difference k of a pair in it, and bits of a hash that must be 0."""
    top = FIRST_BAND << band
    k = 2 * top * (100 - percent) // (100 + percent)
    if top <= EXACT_SIZE:
        return max(EXACT_PARTITIONS[band], k + 1), k, 0
    return PARTITIONS, 0, max(0, (top // 256).bit_length() - 1)


def least_shared(band: int, percent: int = PERCENT, sigmas: float = 4.5) -> int:
    """Signatures of a band with a sampled domain that two sets at the threshold share, but for a chance of about 1e-5.

    Of a set with a features in p partitions, the partner differs in up to a third; those soil partitions, the rest
    agree unless empty. Where the domain is sampled, the number of differences varies, too.
    """
    p, _, zero = partitions(band, percent)
    worst = float("inf")
    for size in range(max(1, (FIRST_BAND << band) * percent // 200), (FIRST_BAND << band) + 1, max(1, 1 << band)):
        a = size / 2**zero
        d = a * (100 - percent) / percent
        mean = p * np.exp(-d / p) * (1 - np.exp(-(a - d / 2) / p))
        spread = 0.4 * mean + (mean * np.sqrt(d) / p) ** 2 * (zero > 0)
        worst = min(worst, mean - sigmas * np.sqrt(spread))
    return max(1, int(worst))


def signatures(features: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signature hashes as signed 64-bit integers, tagged in their low bits."""
    out: list[np.ndarray] = []
    for band in bands(len(features), percent):
        n, k, zero = partitions(band, percent)
        part = features[: np.searchsorted(features, np.uint64(1 << (64 - zero)))] if zero else features
        place = ((part & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(n, np.uint64)
        np.add.at(content, place, common.mix(part ^ np.uint64(0x51ED270B)))
        filled = np.flatnonzero(np.bincount(place, minlength=n))
        out.append(_tagged(common.mix(content[filled] + np.uint64(band)), band, filled))
        if not zero and len(filled) <= k:
            out.append(_tagged(common.mix(features ^ np.uint64(0xA0761D64)), band + SINGLES, np.zeros(len(features), np.int64)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _tagged(h: np.ndarray, band: int, place: np.ndarray) -> np.ndarray:
    low = (1 << PLACE_BITS + BAND_BITS) - 1
    return (h & ~np.uint64(low)) | np.uint64((band & (1 << BAND_BITS) - 1) << PLACE_BITS) | place.astype(np.uint64)


def band_of(sig: Column) -> Column:
    return F.shiftright(sig, PLACE_BITS).bitwiseAND((1 << BAND_BITS) - 1)


def describe(docs: DataFrame, id_column: str, text: str, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n, d1, d2, f0, f1, sigs): the set's size, a 128-bit digest of it, its signatures, and how many of them are
    of partitions of its own band and of the next."""
    names = ("n", "d1", "d2", "f0", "f1")
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in names), T.StructField("sigs", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, at, raw in common.blocks(common.column(batch, "text"), BLOCK_BYTES):
            sets = shingle_sets(at, raw, n)
            d1 = np.array([common.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([common.mix(s + np.uint64(0x2545F491)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            sigs = [signatures(s, percent) if len(s) else np.zeros(0, np.int64) for s in sets]
            fills = [np.bincount((x >> PLACE_BITS & (1 << BAND_BITS) - 1) - bands(len(s), percent)[0], minlength=2) if len(s) else (0, 0) for s, x in zip(sets, sigs, strict=True)]
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sigs, np.zeros(0, np.int64)])))
            numbers = [np.array([len(s) for s in sets], np.int64), d1, d2, *(np.array([f[k] for f in fills], np.int64) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([common.column(batch, "id").slice(lo, hi - lo), *map(pa.array, numbers), listed], names=schema.names)

    return common.arrow_map(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")), run, schema)


def verify(pairs: DataFrame, docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ids whose texts' sets are similar enough; docs has one row (id, text) for each id.

    The texts of b travel once; that of a goes to a task for each PIVOT_ROWS of its partners.
    """
    few = pairs.count() <= BROADCAST_IDS // 2
    counted = pairs.groupBy("a").agg(F.count("*").alias("size"), F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("salts"))
    pivots = common.saved(counted)
    salted = common.join_once(pairs, pivots, ["a"], "size").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    second = docs.withColumnsRenamed({"id": "b", "text": "text_b"}).join(F.broadcast(salted) if few else salted, "b")
    copies = pivots.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    first = docs.withColumnsRenamed({"id": "a", "text": "text_a"}).join(F.broadcast(copies) if few else copies, "a")
    both = second.join(first, ["a", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            a, texts_a, keep = common.column(batch, "a").to_pylist(), common.column(batch, "text_a"), []
            for lo, _, at, raw in common.blocks(common.column(batch, "text_b"), BLOCK_BYTES):
                for k, right in enumerate(shingle_sets(at, raw, n), lo):
                    if known[0] != a[k]:
                        known = (a[k], shingle_sets(*list(common.blocks(texts_a.slice(k, 1)))[0][2:], n)[0])
                    left = known[1]
                    small, large = (left, right) if len(left) < len(right) else (right, left)
                    place = np.searchsorted(large, small)
                    place[place == len(large)] = 0
                    shared = int((large[place] == small).sum()) if len(large) else 0
                    keep.append(shared > 0 and 100 * shared >= percent * (len(left) + len(right) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([common.column(batch, c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sampled_needs(percent: int) -> list[int]:
    """least_shared by band, 0 where the bound is exact."""
    return [least_shared(k, percent) if k >= len(EXACT_PARTITIONS) else 0 for k in range(SINGLES)]


def _by_band(band: Column, exact: Column, single: Column, percent: int) -> Column:
    """`exact` where the whole domain is divided, `single` for single features, else what sampled bands share."""
    sampled = F.array(*map(F.lit, _sampled_needs(percent)))
    return F.when(band >= SINGLES, single).when(band < len(EXACT_PARTITIONS), F.greatest(F.lit(1), exact)).otherwise(F.get(sampled, band.cast("int"))).cast("long")


def needed_at_least(band: Column, n: Column, f: Column, percent: int = PERCENT) -> Column:
    """Signatures of the band that a set of n features and f signatures there shares with any similar one."""
    return _by_band(band, f - F.floor(n * (100 - percent) / percent), F.ceil(n * percent / 100), percent)


def needed(band: Column, na: Column, nb: Column, fa: Column, fb: Column, percent: int = PERCENT) -> Column:
    """Signatures of the band that these two sets share if they are similar: their difference soils one partition a feature."""
    differ = F.floor((na + nb) * (100 - percent) / (100 + percent))
    return _by_band(band, F.greatest(fa, fb) - differ, F.ceil(F.greatest(na, nb) * percent / 100), percent)


def _fits(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _fill(band: Column, n: Column, f0: Column, f1: Column) -> Column:
    """Signatures of a set in the band: f0 in its own one, f1 in the next."""
    own = F.greatest(F.lit(0), F.length(F.bin(n - 1)) - F.lit((FIRST_BAND - 1).bit_length()))
    return F.when(band == own, f0).otherwise(f1)


def _small_pairs(small: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in small buckets that can share enough signatures of a band; those in large buckets count in full."""
    rows = small.join(hot.select("class", "band", "hot"), ["class", "band"], "left")
    side = lambda x: rows.select("sig", "band", F.col("class").alias(x), *(F.col(c).alias(c + x) for c in ("n", "f", "comp", "hot")))
    met = side("a").join(side("b"), ["sig", "band"]).where((F.col("a") < F.col("b")) & (F.col("compa") != F.col("compb")) & _fits(F.col("na"), F.col("nb"), percent))
    enough = needed(F.col("band"), F.col("na"), F.col("nb"), F.col("fa"), F.col("fb"), percent)
    large = F.least(F.coalesce("hota", F.lit(0)), F.coalesce("hotb", F.lit(0)))
    counted = met.groupBy("a", "b", "band").agg(F.count("*").alias("votes"), F.min(enough).alias("enough"), F.max(large).alias("hot"))
    return counted.where(F.col("votes") + F.col("hot") >= F.col("enough")).select("a", "b")


def _dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, class, comp, ...) of keys with several components, with `own`, their block, once for each pair (i, j) of
    blocks that theirs is compared in: all but those within the key's largest component."""
    parts = rows.groupBy(key, "comp").agg(F.count("*").alias("rows"))
    sizes = parts.groupBy(key).agg(F.max(F.struct("rows", "comp")).alias("m"), F.sum("rows").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda c: F.ceil(c / block).cast("int")
    sizes = common.saved(sizes.select(key, "size", F.col("m.comp").alias("_main"), blocks(F.col("m.rows")).alias("_mains"), blocks(F.col("size") - F.col("m.rows")).alias("_others")))
    known = common.join_once(rows, sizes, [key], "size")
    main, hashed = F.col("comp") == F.col("_main"), F.xxhash64("class", key)
    own = F.when(main, F.col("_others") + F.pmod(hashed, F.col("_mains"))).otherwise(F.pmod(hashed, F.col("_others"))).cast("int")
    last = F.col("_others") - 1 + F.when(main, 0).otherwise(F.col("_mains"))
    dealt = known.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_main", "_mains", "_others", "_other")


def _overlaps(lists: list[np.ndarray], own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, common elements) of block i against block j; elements of a list are distinct."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    _, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    met = times[at] > 1
    row, at = np.repeat(np.arange(len(lists)), sizes)[met], number[at[met]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    shared = np.zeros((len(left), len(right)), np.float32)
    top = int(at[-1]) + 1 if len(at) else 0
    for k in range(0, top, 2048):
        a, b = np.searchsorted(at, (k, k + 2048))
        holds = np.zeros((len(lists), min(2048, top - k)), np.float32)
        holds[row[a:b], at[a:b] - k] = 1
        shared += holds[left] @ holds[right].T
    return left, right, shared


def _forest(left: np.ndarray, right: np.ndarray, joined: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that connect what `joined` (left x right) connects beyond equal components."""
    root = np.unique(comp, return_inverse=True)[1]
    out = []
    joined = joined & (root[left][:, None] != root[right][None, :])
    while True:
        x, y = np.nonzero(joined)
        if not len(x):
            return out
        # one pair for each component on either side, so that each round halves them, then those components are the same
        first = np.unique(np.concatenate([np.unique(root[left[x]], return_index=True)[1], np.unique(root[right[y]], return_index=True)[1]]))
        for a, b in zip(left[x[first]].tolist(), right[y[first]].tolist(), strict=True):
            if root[a] != root[b]:
                out.append((a, b))
                root[root == max(root[a], root[b])] = min(root[a], root[b])
        joined &= root[left][:, None] != root[right][None, :]


def _large_edges(large: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect all pairs of classes of different components in large buckets that share enough signatures of the bucket's band."""
    # Two lists that share `need` of the same order share one of the first `hot - need + 1` of each; signatures of small buckets are the first
    own = Window.partitionBy("class", "band")
    ranked = large.withColumns({"hot": F.count("*").over(own), "place": F.row_number().over(own.orderBy("held", "sig")), "need": needed_at_least(F.col("band"), F.col("n"), F.col("f"), percent)})
    rows = common.saved(ranked.where("place <= hot - need + 1").select("sig", "class", "band", "n", "f", "comp"))
    mine = F.filter("sigs", lambda s: band_of(s) == F.col("band"))  # whole, as two that are shortened to one would cost a pair its vote
    listed = rows.select("class", "band").distinct().join(classes.select("class", "sigs"), "class").select("class", "band", F.array_distinct(mine).alias("sigs"))
    keyed = _dealt(rows, "sig", SIGNATURE_BLOCK).join(listed, ["class", "band"])
    exact, sampled = len(EXACT_PARTITIONS), _sampled_needs(percent)

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        band, i, j = (group[c][0].as_py() for c in ("band", "i", "j"))
        own, n, f, comp, ids = (group[c].to_numpy() for c in ("own", "n", "f", "comp", "class"))
        column = group["sigs"].chunk(0)
        lists = np.split(column.flatten().to_numpy(), np.cumsum(np.diff(column.offsets.to_numpy()))[:-1])
        left, right, shared = _overlaps(lists, own, i, j)
        least, most = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        if band >= SINGLES:
            enough = np.ceil(most * percent / 100)
        elif band < exact:
            enough = np.maximum(1, np.maximum(f[left][:, None], f[right][None, :]) - (least + most) * (100 - percent) // (100 + percent))
        else:
            enough = sampled[band]
        found = (shared >= enough) & (least * 100 >= most * percent) & (comp[left][:, None] != comp[right][None, :])
        # each class is a node of its own: which of a component's classes are linked outside of it isn't known yet
        return _pair_table([(ids[a], ids[b]) for a, b in _forest(left, right, found, ids)])

    return keyed.groupBy("sig", "i", "j").applyInArrow(count, "a long, b long")


def _pair_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})


def _cluster_links(clusters: DataFrame, labels: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) that connect all linked classes of each cluster (class, cluster), by exact comparison of its sets."""
    known = common.saved(clusters.join(labels, "class", "left").select("class", "cluster", F.coalesce("comp", "class").alias("comp")))
    several = known.groupBy("cluster").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("cluster", "size")
    wanted = common.saved(common.join_once(known, common.saved(several), ["cluster"], "size"))
    texts = docs.withColumnRenamed("id", "class").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "class")

    def parse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, at, raw in common.blocks(common.column(batch, "text"), BLOCK_BYTES):
            part = batch.slice(lo, hi - lo)
            sets = pa.array([s.tobytes() for s in shingle_sets(at, raw, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([common.column(part, c) for c in ("class", "cluster", "comp")] + [sets], names=["class", "cluster", "comp", "features"])

    sets = common.arrow_map(texts.select("class", "cluster", "comp", "text"), parse, "class long, cluster long, comp long, features binary")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        own, comp, ids = (group[c].to_numpy() for c in ("own", "comp", "class"))
        lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["features"]]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        left, right, shared = _overlaps(lists, own, i, j)
        linked = (shared > 0) & (shared * 100 >= percent * (size[left][:, None] + size[right][None, :] - shared))
        return _pair_table([(ids[a], ids[b]) for a, b in _forest(left, right, linked, comp)])

    dealt = common.saved(_dealt(wanted, "cluster", BLOCK).select("class", "cluster", "own", "i", "j"))
    return sets.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_IDS else dealt, ["class", "cluster"]).groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long").toDF("u", "v")


def links(docs: DataFrame, classes: DataFrame, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """Verified links (u, v) between classes that connect every two classes connected by links at all."""
    listed = classes.select("class", F.explode("sigs").alias("sig"))
    sizes = classes.select("class", "n", "f0", "f1")
    shared = common.saved(listed.groupBy("sig").agg(F.min("class").alias("pivot"), F.count("*").alias("size")).where("size > 1"))
    members = common.saved(common.join_once(listed, shared, ["sig"], "size").withColumn("band", band_of(F.col("sig"))))
    votes = members.where("class <> pivot").repartition("class").groupBy("class", "pivot", "band").agg(F.count("*").alias("votes"))
    filled = _fill(F.col("band"), F.col("n"), F.col("f0"), F.col("f1"))
    likely = votes.join(sizes, "class").where(2 * F.col("votes") >= needed_at_least(F.col("band"), F.col("n"), filled, percent))
    best = likely.groupBy("class").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("p"))).alias("m"))
    tried = common.saved(best.select((-F.col("m.p")).alias("a"), F.col("class").alias("b")))
    found = common.saved(verify(tried, docs, n, percent).toDF("u", "v"))
    labels = common.saved(components(found).toDF("class", "comp"))
    rows = members.join(labels, "class", "left").select("sig", "class", "band", F.coalesce("comp", "class").alias("comp"))
    held = common.saved(rows.groupBy("sig").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", "size", F.col("size").alias("held")))
    open_rows = common.join_once(rows, held, ["sig"], "size").join(sizes, "class")
    still = common.saved(open_rows.select("sig", "class", "band", "comp", "held", "n", filled.alias("f")))
    small, large = still.where(F.col("held") <= BUCKET), still.where(F.col("held") > BUCKET)
    hot = common.saved(large.groupBy("class", "band").agg(F.count("*").alias("hot"), F.first("n").alias("n"), F.first("f").alias("f")))
    edges = _small_pairs(small, hot, percent).unionByName(_large_edges(large, classes, percent)).distinct()
    clusters = components(edges.toDF("u", "v")).toDF("class", "cluster")
    return found.unionByName(_cluster_links(clusters, labels, docs, n, percent))


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id reachable by links, the own one included."""
    with common.Scratch() as run:
        described = common.saved(describe(docs, id_column, text, n, percent))
        known = described.where("n > 0 and id is not null")
        named = common.saved(known.groupBy("n", "d1", "d2").agg(F.min("id").alias("class"), F.count("*").alias("rows")))
        digest = ["n", "d1", "d2"]
        same = common.join_once(known.select("id", *digest), named.where("rows > 1"), digest, "rows").where("id <> class")
        copies = common.saved(same.select("id", *digest, "class"))
        first = known.join(F.broadcast(copies.drop("class")) if copies.count() <= BROADCAST_IDS // 4 else copies.drop("class"), ["id", *digest], "left_anti")
        twice = common.saved(known.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
        again = copies.select(F.col("id").alias("u"), F.col("class").alias("v")).join(twice, F.col("u") == twice["id"], "left_semi")
        if not twice.isEmpty():
            first = first.dropDuplicates(["id", *digest])
        classes = first.select(F.col("id").alias("class"), "n", "f0", "f1", "sigs")
        plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
        labels = components(links(plain, classes, n, percent).unionByName(again)).withColumnRenamed("node", "class")
        labelled = common.saved(named.join(labels, "class", "left").select(*digest, "rows", F.coalesce("component", "class").alias("comp")))
        out = common.join_once(described.select("id", *digest), labelled, digest, "rows", "left")
        return run.result(out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id")))
