"""Operators on changing tables: signed rows, retention, undo records, state rows, running values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cancel_rows(rows: DataFrame, where: Column, sign: str = "sign") -> DataFrame:
    """Rows of sign -1 that cancel what signed rows under `where` still add up to.

    Rows are netted over all other columns; a net of n gives n rows; negative nets give none.
    """
    columns = [c for c in rows.columns if c != sign]
    net = rows.where(where).groupBy(*columns).agg(F.sum(sign).alias("_net")).where("_net > 0")
    return net.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_net").cast("int")))).select(*columns, F.lit(-1).cast(rows.schema[sign].dataType).alias(sign)).select(*rows.columns)


def cancel_query(rows: DataFrame, sign: str = "sign") -> DataFrame:
    """Every row once more with sign -1, without netting."""
    return rows.withColumn(sign, F.lit(-1).cast(rows.schema[sign].dataType))


def collapsed(rows: DataFrame, keys: Sequence[str], sign: str = "sign") -> DataFrame:
    """Keys whose signs add up to more than 0, with that sum."""
    return rows.groupBy(*keys).agg(F.sum(sign).alias("balance")).where("balance > 0")


def keep_newest(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n newest rows of each key (Spark stops early in each task before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def newest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key, by aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def retain_blocks(states: DataFrame, current: int, finalized: int | None, retention: int, number: str = "current_number") -> DataFrame:
    """States that retention keeps: those above min(current, finalized) - retention, a limit of 0 at least."""
    limit = max(0, min(current, current if finalized is None else finalized) - retention)
    return states.where(F.col(number) > limit)


def first_images(log: DataFrame, keys: Sequence[str], above: int, number: str = "block_number", order: Sequence[str] = ()) -> DataFrame:
    """The first undo record of each key above a block: what a rollback to that block restores."""
    rest = [c for c in log.columns if c not in keys]
    record = F.min_by(F.struct(*rest), F.struct(number, *order)).alias("_row")
    return log.where(F.col(number) > above).groupBy(*keys).agg(record).select(*keys, "_row.*").select(*log.columns)


def roll_back(rows: DataFrame, log: DataFrame, keys: Sequence[str], safe: int, number: str = "block_number", operation: str = "operation") -> DataFrame:
    """The table as of block `safe`: keys that were inserted since go, others get their first image since."""
    images = first_images(log, keys, safe, number)
    kept = rows.join(images.select(*keys), list(keys), "left_anti")
    back = images.where(F.col(operation) != "INSERT").select(*rows.columns)
    return kept.unionByName(back)


def delete_range(rows: DataFrame, low: int, high: int | None, number: str = "block_number") -> DataFrame:
    """What is left without blocks in (low, high]."""
    gone = F.col(number) > low if high is None else (F.col(number) > low) & (F.col(number) <= high)
    return rows.where(~gone)


def upsert(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def insert_or_ignore(rows: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that are there win; of several new ones with a key the first in order is taken."""
    from .joins import first_by

    return rows.unionByName(first_by(new, keys, order).join(rows.select(*keys), list(keys), "left_anti"))


def duplicates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def running_max(rows: DataFrame, order: str, value: str, out: str, span: int = 10_000) -> DataFrame:
    """The greatest value so far along a dense integer order.

    Not one window over all rows: each stretch of `span` positions is scanned by itself, on top of the maximum of all
    stretches before it, so only one row for each stretch meets in one place.
    """
    cut = rows.withColumn("_part", F.floor(F.col(order) / span))
    tops = cut.groupBy("_part").agg(F.max(value).alias("_top"))
    before = F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("_part", before.alias("_before"))
    inside = F.max(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.join(tops, "_part").withColumn(out, F.greatest(inside, F.col("_before"))).drop("_part", "_before")


def previous(rows: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = 100_000) -> DataFrame:
    """`value` of the row before, by key along an integer order. Rows meet in stretches of `span` positions only."""
    cut = rows.withColumn("_part", F.floor(F.col(order) / span))
    lasts = cut.groupBy(*keys, "_part").agg(F.max_by(value, order).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part"))
    inside = F.lag(value).over(Window.partitionBy(*keys, "_part").orderBy(order))
    joined = cut.join(lasts.select(*keys, "_part", before.alias("_last_before")), [*keys, "_part"])
    return joined.withColumn(out, F.coalesce(inside, F.col("_last_before"))).drop("_part", "_last_before")


def continuity(blocks: DataFrame, keys: Sequence[str] = (), number: str = "number", hash_: str = "hash", parent: str = "parent") -> DataFrame:
    """What breaks chains of blocks, in any order of rows: (keys, problem, low, high, n).

    `gap`: no block low to high, n numbers, between two blocks of a key. `repeat`: number low = high has n > 1 rows. `link`: n rows of number
    low = high name a parent that isn't among the blocks before, though there are some. Rows without a number are left out, a null parent is no link,
    and null keys are a key. Rows meet by number and hash with partial sums, so a block that is repeated very often is no hot key; only a
    row for each stretch of numbers meets in a window by key.
    """
    by = [F.col(k) for k in keys]
    rows = blocks.where(F.col(number).isNotNull())
    own = rows.select(*by, F.col(number).cast("bigint").alias("_at"), F.col(hash_).alias("_hash"), F.lit(1).alias("_own"), F.lit(0).alias("_child"))
    child = rows.where(F.col(parent).isNotNull()).select(*by, (F.col(number) - 1).cast("bigint"), F.col(parent), F.lit(0), F.lit(1))
    named = own.union(child).groupBy(*keys, "_at", "_hash").agg(F.sum("_own").alias("_own"), F.sum("_child").alias("_child"))
    lost = F.sum(F.when(F.col("_own") == 0, F.col("_child")).otherwise(0)).alias("_lost")
    met = named.groupBy(*keys, "_at").agg(F.sum("_own").alias("_rows"), lost).where("_rows > 0")
    # null keys have to meet in the join of stretches, so they are marked beside a value that isn't null
    marks = {f"_k{i}": F.coalesce(F.to_json(F.struct(F.col(k).alias("k"))), F.lit("")) for i, k in enumerate(keys)}
    seen = previous(met.withColumns(marks) if marks else met, list(marks), "_at", "_at", "_before")
    problem = lambda name, low, high, n: F.struct(F.lit(name).alias("problem"), low.alias("low"), high.alias("high"), n.cast("bigint").alias("n"))
    at, before = F.col("_at"), F.col("_before")
    found = F.array_compact(
        F.array(
            F.when(at > before + 1, problem("gap", before + 1, at - 1, at - before - 1)),
            F.when(F.col("_rows") > 1, problem("repeat", at, at, F.col("_rows"))),
            F.when(F.col("_lost") > 0, problem("link", at + 1, at + 1, F.col("_lost"))),
        )
    )
    return seen.select(*by, F.explode(found).alias("_p")).select(*by, "_p.*")


def coverage_windows(checkpoints: DataFrame, keys: Sequence[str], seed: int, upto: str = "to_block") -> DataFrame:
    """The window that each published file accounts for: from the block after the one before it, the first from `seed`."""
    return previous(checkpoints, keys, upto, upto, "_previous").withColumn("from_block", F.coalesce(F.col("_previous") + 1, F.lit(seed))).drop("_previous")


def numbered(rows: DataFrame, keys: Sequence[str], order: str, out: str, span: int = 100_000) -> DataFrame:
    """Rows numbered from 0 by key along an integer order; rows meet in stretches of `span` positions only."""
    cut = rows.withColumn("_part", F.floor(F.col(order) / span))
    sizes = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1
    joined = cut.join(sizes.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before")), [*keys, "_part"])
    return joined.withColumn(out, inside + F.col("_before")).drop("_part", "_before")


def throughput(samples: DataFrame, keys: Sequence[str], order: str = "ts", blocks: str = "block_number", size: str = "bytes", rows: int = 100, stretch: int = 10_000) -> DataFrame:
    """Blocks and bytes a second over the last `rows` samples of each key; 0 where no time has passed.

    The samples of a key are cut into stretches of so many rows, each with the rows - 1 samples before it.
    """
    placed = numbered(samples, keys, order, "_n").withColumn("_own", F.floor(F.col("_n") / stretch))
    late = F.col("_n") % stretch > stretch - rows
    parts = placed.withColumn("_stretch", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    recent = Window.partitionBy(*keys, "_stretch").orderBy("_n").rowsBetween(1 - rows, Window.currentRow)
    seconds = F.col(order) - F.min(order).over(recent)
    rate = lambda x: F.when(seconds > 0, x / seconds).otherwise(F.lit(0.0))
    rated = parts.withColumns({"blocks_per_s": rate(F.col(blocks) - F.first(blocks).over(recent)), "bytes_per_s": rate(F.sum(size).over(recent))})
    return rated.where("_own = _stretch").drop("_n", "_own", "_stretch")


def progress(states: DataFrame, blocks_per_s: Column, current: str = "current", initial: str = "initial", last: str = "last") -> DataFrame:
    """States with `percent` done and `eta_seconds`; 0 where nothing is to do or nothing moves."""
    at_least = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    percent = F.when(at_least(last, initial) > 0, at_least(current, initial) / at_least(last, initial) * 100).otherwise(F.lit(0.0))
    return states.withColumns({"percent": percent, "eta_seconds": F.when(blocks_per_s > 0, at_least(last, current) / blocks_per_s).otherwise(F.lit(0.0))})


def merged_counts(batches: DataFrame, counts: str = "requests", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, status, n): the sums of a map column from statuses to counts over all batches."""
    return batches.select(*keys, F.explode(counts).alias("status", "_n")).groupBy(*keys, "status").agg(F.sum("_n").alias("n"))


def page(rows: DataFrame, order: Sequence[str], size: int, after: Sequence | None = None, descending: bool = False) -> DataFrame:
    """The next `size` rows in order, after a row's values of the ordering columns: what comes before is never sorted."""
    here = rows
    if after is not None:
        place, last = F.struct(*order), F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)])
        here = rows.where(place < last if descending else place > last)
    return here.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order]).limit(size)


def outputs(rows: DataFrame, takes: dict[str, Column]) -> DataFrame:
    """Several outputs of one scan: a row for each output (column `output`) that takes it."""
    taken = F.array_compact(F.array(*[F.when(where, F.lit(name)) for name, where in takes.items()]))
    return rows.withColumn("output", F.explode(taken))


def rollback_chains(blocks: DataFrame, keys: Sequence[str], head: Column, number: str = "block_number") -> DataFrame:
    """Of each key the sorted numbers of the blocks above its head (`chain`), as far as there are any."""
    return blocks.where(F.col(number) > head).groupBy(*keys).agg(F.sort_array(F.collect_set(number)).alias("chain"))


def head(headers: DataFrame, number: str = "number", hash_: str = "hash", finalized: int | None = None) -> DataFrame:
    """The highest block (number, hash), of those up to the finalized one if that is given; no row for an empty table."""
    inside = headers if finalized is None else headers.where(F.col(number) <= finalized)
    return inside.agg(F.max(F.struct(F.col(number).alias("number"), F.col(hash_).alias("hash"))).alias("h")).where("h is not null").select("h.*")


def block_at(headers: DataFrame, seconds: Column | int, number: str = "number", time: str = "timestamp") -> DataFrame:
    """The first block at or after a time; null if there is none."""
    at = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return headers.where(F.col(time) >= at).agg(F.min(number).alias("number"))


def rows_to_remove(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(where).agg(F.count("*").alias("n"))


def highest_head(heads: DataFrame, keys: Sequence[str], number: str = "number", arrival: str = "arrival") -> DataFrame:
    """The highest head of each key; of equal numbers the one that arrived first."""
    rest = [c for c in heads.columns if c not in keys]
    return heads.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(number, (-F.col(arrival)).alias("a"))).alias("_row")).select(*keys, "_row.*")


def status_counts(requests: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Requests that succeeded (2xx), were limited (429) or failed."""
    ok, limited = F.col(status).between(200, 299), F.col(status) == 429
    count = lambda c: F.sum(c.cast("long"))
    return requests.groupBy(*keys).agg(count(ok).alias("succeeded"), count(limited).alias("limited"), count(~ok & ~limited).alias("failed"))


def status_shares(requests: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """status_counts with their sum (`total`) and percentages of it."""
    counted = status_counts(requests, keys, status).withColumn("total", F.col("succeeded") + F.col("limited") + F.col("failed"))
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(F.lit(0.0))
    return counted.withColumns({f"{c}_percent": share(c) for c in ("succeeded", "limited", "failed")})


def histogram(rows: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts: (le, n) rows at most le, for each bound and for all (le null). One pass."""
    parts = [F.struct(F.lit(float(b)).alias("le"), F.sum((F.col(value) <= b).cast("long")).alias("n")) for b in bounds]
    parts.append(F.struct(F.lit(None).cast("double").alias("le"), F.count("*").alias("n")))
    return rows.agg(F.array(*parts).alias("b")).select(F.explode("b").alias("b")).select("b.le", F.coalesce("b.n", F.lit(0)).alias("n"))


def segments(requests: DataFrame, low: str = "low", high: str = "high", id_column: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Overlapping ranges of each key as disjoint segments (keys, low, high, ids), the relational form of merging requests.

    Positions fall into buckets of the ranges' mean length, so requests (each in every bucket that it touches, two on
    average) meet the segments that start in a bucket by equality. Only one row for each bucket meets in a window by key.
    """
    span = requests.agg(F.avg(F.col(high) - F.col(low) + 1)).first()[0]
    width = max(1, int(span or 1))
    bucket = lambda at: F.floor(at / F.lit(width))
    rows = requests.select(*keys, F.col(low).alias("_from"), F.col(high).alias("_to"), F.col(id_column).alias("_id"))
    cuts = rows.select(*keys, F.explode(F.array("_from", F.col("_to") + 1)).alias("seg_low")).distinct().withColumn("_part", bucket(F.col("seg_low")))
    firsts = cuts.groupBy(*keys, "_part").agg(F.min("seg_low").alias("_first"))
    after = firsts.select(*keys, "_part", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part")).alias("_after"))
    inside = F.lead("seg_low").over(Window.partitionBy(*keys, "_part").orderBy("seg_low"))
    pieces = cuts.withColumn("_next", inside).join(after, [*keys, "_part"]).withColumn("seg_high", F.coalesce("_next", "_after") - 1)
    asked = rows.withColumn("_part", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    met = pieces.select(*keys, "_part", "seg_low", "seg_high").join(asked, [*keys, "_part"]).where("_from <= seg_low and _to >= seg_high")
    return met.groupBy(*keys, "seg_low", "seg_high").agg(F.sort_array(F.collect_list("_id")).alias("ids")).withColumnsRenamed({"seg_low": "low", "seg_high": "high"})
