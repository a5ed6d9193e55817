"""Joins of block-structured entities: factory children, transactions, balances, call trees, chain heads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import previous, unused


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in the given order, by aggregation (no sort of whole groups)."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def factory_children(creations: DataFrame, child: Column, stored: DataFrame | None = None, position: Sequence[str] = ("block_number", "log_index")) -> DataFrame:
    """Children by address. The first creation wins, one in these rows before a stored one; null or empty children are skipped.

    Creations of any emitter count here; `lookup` tests the emitter, so a foreign factory that came first keeps the key.
    """
    rows = creations.withColumn("child_address", F.lower(child)).where("child_address is not null and child_address <> ''")
    fresh = first_by(rows, ["child_address"], list(position))
    return fresh if stored is None else fresh.unionByName(stored.join(fresh.select("child_address"), "child_address", "left_anti"))


def lookup(children: DataFrame, factories: Sequence[str] | None = None, params: Mapping[str, Sequence[str]] | None = None, factory: str = "factory_address") -> DataFrame:
    """The children of these factories whose creation event has the given values: any case, values ORed, params ANDed."""
    out = children if factories is None else children.where(F.lower(factory).isin([f.lower() for f in factories]))
    for name, values in (params or {}).items():
        out = out.where(F.lower(F.col(name).cast("string")).isin([str(v).lower() for v in values]))
    return out


def address_filter(addresses: DataFrame, address: str, n: int, most_bits: int = 1 << 26) -> Callable[[Column], Column]:
    """A Bloom filter of a table's addresses, as a predicate: true for each of them, and for few others (1 % at 10 bits an address).

    n: their number, as it sizes the filter. The bits, 8 MB at most however many addresses there are, are one value that Spark computes
    before the scan that uses them; bits are set by an aggregation of words, so each task sends each word once.
    """
    bits = min(most_bits, 1 << max(10, (10 * n).bit_length()))
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits)) for seed in range(5)]
    mask = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % 64).cast("int"))
    found = addresses.where(F.col(address).isNotNull()).select(F.explode(F.array(*places(F.col(address)))).alias("place"))
    marks = found.select(F.expr("place div 64").alias("at"), mask(F.col("place")).alias("word"))
    every = marks.union(addresses.sparkSession.range(bits // 64).select("id", F.lit(0).cast("bigint"))).groupBy("at").agg(F.bit_or("word").alias("word"))
    held = every.agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")).select(F.col("w.word").alias("w")).scalar()

    def test(column: Column) -> Column:
        there = lambda p: F.get(held, F.shiftright(p, 6).cast("int")).bitwiseAND(mask(p)) != 0
        return reduce(lambda a, b: a & b, [there(p) for p in places(column)])

    return test


def join_children(logs: DataFrame, children: DataFrame, address: str = "address", broadcast_up_to: int = 100_000, share: int = 1000) -> DataFrame:
    """Logs of child contracts with their creation record. Not temporal: logs before the creation match as well. One child an address.

    Up to so many children go to the logs. Beyond, logs of others leave in the scan by a Bloom filter of the children's addresses, and what
    stays meets the children by address; addresses with more than one of `share` of those logs (there are fewer than `share`) are met where the logs are.
    """
    made = children.withColumnRenamed("child_address", address)
    n = made.count()
    if n <= broadcast_up_to:
        return logs.join(F.broadcast(made), address)
    near = logs.where(address_filter(made, address, n)(F.col(address)))
    sizes = near.groupBy(address).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n")).scalar()
    hot = [r[0] for r in sizes.where(F.col("n") * share > whole).select(address).collect()]
    if not hot:
        return near.join(made, address)
    is_hot = F.col(address).isin(hot)
    return near.where(~is_hot).join(made.where(~is_hot), address).unionByName(near.where(is_hot).join(F.broadcast(made.where(is_hot)), address))


def with_transaction(items: DataFrame, transactions: DataFrame, keys: Sequence[str] = ("block_number", "transaction_index")) -> DataFrame:
    """Items with their transaction; items whose transaction isn't there stay, with nulls. The first of several wins."""
    return items.join(transactions.dropDuplicates(list(keys)), list(keys), "left")


def collect_related(items: DataFrame, others: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Items with the array of the other entity's rows of the same transaction, sorted; empty if there are none."""
    listed = others.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = listed.schema[name].dataType.simpleString()
    return items.join(listed, list(keys), "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def path_key(path: Column) -> Column:
    """A path of positions as text that sorts like it: a path's extensions follow it, before anything else. Positions aren't negative."""
    return F.array_join(F.transform(path, lambda x: F.lpad(F.hex(x.cast("bigint")), 16, "0")), "")


def descendant_counts(items: DataFrame, path: str, keys: Sequence[str], name: str = "n_inner") -> DataFrame:
    """Items with the number of items of the same keys whose path extends theirs (0 for a null path); no pair is made.

    In the order of `path_key` a subtree is a run of neighbours, so its size is the number of items before its end less the number up to
    its root: one exchange by the keys, one sort, and a second one by path. 100,000 items of one transaction take seconds.
    """
    at = lambda stem: unused(items, stem)
    key, ends, order, before, last, row = (at(x) for x in ("_key", "_ends", "_order", "_before", "_last", "_row"))
    marked = items.select(*keys, path_key(F.col(path)).alias(key), F.struct(*items.columns).alias(row)).withColumn(ends, F.explode(F.array(F.lit(False), F.lit(True))))
    # hexadecimal digits sort below the tilde, so it ends the subtree; rows that end one carry no item
    marked = marked.where(~F.col(ends) | F.col(key).isNotNull()).withColumn(order, F.when(F.col(ends), F.concat(key, F.lit("~"))).otherwise(F.col(key)))
    marked = marked.withColumn(row, F.when(~F.col(ends), F.col(row)))
    upto = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.withColumn(before, F.sum((~F.col(ends) & F.col(key).isNotNull()).cast("bigint")).over(upto))
    inside = F.max(F.when(F.col(ends), F.col(before))).over(Window.partitionBy(*keys, key))
    found = counted.withColumn(last, inside).where(~F.col(ends))
    known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys], F.lit(True))  # null keys equal nothing
    return found.select(f"{row}.*", F.coalesce(F.when(known, F.col(last) - F.col(before)), F.lit(0)).cast("bigint").alias(name))


def descendants(items: DataFrame, path: str, keys: Sequence[str], inner: DataFrame | None = None) -> DataFrame:
    """Pairs (outer, inner) of one transaction where the inner path extends the outer one, for those who need the pairs themselves.

    An inner item looks its outer ones up by its path's prefixes, so no more pairs are made than there are, and one for each prefix.
    """
    below = (items if inner is None else inner).select(*keys, *[F.col(c).alias(f"inner_{c}") for c in items.columns if c not in keys])
    deep = below.where(F.size(f"inner_{path}") > 0)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(f"inner_{path}") - 1), lambda n: F.slice(f"inner_{path}", F.lit(1), n))
    return items.join(deep.withColumn(path, F.explode(prefixes)), [*keys, path]).select(*items.columns, *[c for c in below.columns if c not in keys])


def ancestors(items: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Each item with its parents' paths as equality keys: one row for each proper prefix, for equi-joins with parents."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n))
    return items.where(F.size(path) > 1).withColumn("parent_path", F.explode(prefixes))


def group_transfers(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("block_number", "transaction_index")) -> DataFrame:
    """Transactions with counts and sums of their inputs and outputs; each side is summed before the join."""
    sides = [
        side.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.sum("value").alias(f"{name}_value"))
        for name, side in (("inputs", inputs), ("outputs", outputs))
    ]
    out = transactions
    for side in sides:
        out = out.join(side, list(keys), "left")
    return out.fillna(0, ["n_inputs", "n_outputs"])


def head_delays(blocks: DataFrame, heads: DataFrame, keep: int = 512) -> DataFrame:
    """Blocks joined by number with the heads that each url reported: received later by so many milliseconds.

    Of each url only the newest `keep` heads count.
    """
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.col("number").desc()))
    recent = heads.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    joined = blocks.join(recent.withColumnRenamed("received_ms", "rpc_received_ms"), "number")
    return joined.withColumn("delay_ms", F.col("received_ms") - F.col("rpc_received_ms"))


def contiguous_prefix(entries: DataFrame, start: int, keys: Sequence[str] = ("query_hash",)) -> DataFrame:
    """Cache entries (block_from, block_to) that follow each other without a gap from the entry at exactly `start`."""
    here = previous(entries.where(F.col("block_from") >= start), keys, "block_from", "block_to", "_before")
    flagged = here.withColumn("_follows", F.col("block_from") == F.coalesce(F.col("_before") + 1, F.lit(start)))
    broken = flagged.where(~F.col("_follows")).groupBy(*keys).agg(F.min("block_from").alias("_broken"))
    return flagged.join(broken, list(keys), "left").where("_broken is null or block_from < _broken").drop("_follows", "_before", "_broken")


def fork_ancestor(chain: DataFrame, canonical: DataFrame) -> DataFrame:
    """The highest stored block that is canonical, too: one row (number, hash), none if the chains share nothing."""
    shared = chain.join(canonical, ["number", "hash"], "left_semi")
    return shared.agg(F.max(F.struct("number", "hash")).alias("m")).where("m is not null").select("m.number", "m.hash")


def linked_ancestor(chain: DataFrame, canonical: DataFrame, fan: int = 1000, stretch: int = 100_000) -> DataFrame:
    """fork_ancestor of chains whose hashes cover all blocks before, one hash a number: one row (number, hash), none if the chains share nothing.

    A shared block has shared ancestors, so its hash is the digest of all blocks up to it. Of stretches of the stored chain, which
    double away from its head, the newest blocks are looked up in the other chain. What is left is the stretch in front of the newest shared
    one; it is cut into `fan` parts again, until it spans no more than `stretch` numbers and is joined. Chains may have gaps. A round
    aggregates the stretch to `fan` rows at most, which the driver sees; nothing else is shuffled.
    """
    ends = chain.agg(F.min("number").alias("low"), F.max("number").alias("high")).first()
    low, high, best, part = ends.low, ends.high, None, lambda behind, _: F.floor(F.log2(behind + 1))
    while low is not None and high - low >= stretch:
        behind = F.lit(high) - F.col("number")
        cut = chain.where(F.col("number").between(low, high)).groupBy(part(behind, high - low + 1).alias("part"))
        newest = cut.agg(F.max("number").alias("number"), F.max_by("hash", "number").alias("hash"), F.min("number").alias("oldest")).collect()
        numbers = [r.number for r in newest]
        looked = chain.sparkSession.createDataFrame([(r.number, r.hash) for r in newest], chain.select("number", "hash").schema)
        shared = canonical.where(F.col("number").isin(numbers)).join(F.broadcast(looked), ["number", "hash"], "left_semi").agg(F.max("number")).first()[0]
        best = shared if shared is not None else best
        above = [r for r in newest if shared is None or r.number > shared]
        front = min(above, key=lambda r: r.number) if above else None
        low, high = (front.oldest, front.number - 1) if front and front.oldest < front.number else (None, None)
        part = lambda behind, size: F.floor(behind * fan / size)
    inside = F.lit(False) if low is None else F.col("number").between(low, high)
    wanted = inside if best is None else inside | (F.col("number") == best)
    return fork_ancestor(chain.where(wanted), canonical.where(wanted))
