"""Sinks by what they promise.

* MemorySink: final rows go to a function; rows above the floor are held back in a table.
* SegmentSink: final rows become Parquet segments named after the blocks they account for, with a state.
* SignedSink: rows are appended at once, a fork appends rows of sign -1 that cancel them.
* TableSink: every batch and every fork is one version of all tables with undo records.
* WriteAheadSink: an intent comes before the rows and a commit after them.

A batch is given as (rows by table, blocks, finalized head). Batches come in order; one that was committed before is skipped.
Rows are written to folders of their own first; they count once the manifest names them, together with the state. Before its
first batch, and after one that failed, a sink recovers: folders that no version names are deleted. So a micro-batch that
stopped at any step and that Spark runs again adds its rows once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import LoomError
from ledgerloom.operators import tables
from ledgerloom.plans.ranges import Range, next_queried
from ledgerloom.streaming.finality import Cursor, PipeState, Record, after_response, ancestor
from ledgerloom.streaming.holdback import HoldBack, dump_state, load_state

from .manifest import Manifest

#: Column types that tables may have, and how deep they may be nested.
LEAVES = (T.LongType, T.IntegerType, T.StringType, T.BinaryType, T.BooleanType, T.DoubleType, T.TimestampType, T.DateType)
MAX_DEPTH = 32


@dataclass(frozen=True)
class Table:
    """A declared table; `keys` are its primary key where rows are updated, `engine` says how rows are removed.

    engine: `plain` (rows are deleted), `collapsing` (rows are cancelled by a sign; `collapse` names the column that the table
    itself collapses by) or `distributed` (rows live elsewhere and can't be removed).
    """

    name: str
    schema: T.StructType
    number: str = "block_number"
    keys: tuple[str, ...] = ()
    engine: str = "plain"
    collapse: str | None = None

    def __post_init__(self) -> None:
        if not self.schema.fields:
            raise LoomError("E2303", self.name)
        for f in self.schema.fields:
            self._supported(f.name, f.dataType, 0)
        if self.number not in self.schema.names:
            raise LoomError("E2304", f"{self.name}.{self.number}")
        if not isinstance(self.schema[self.number].dataType, (T.IntegerType, T.LongType)):
            raise LoomError("E2305", f"{self.name}.{self.number}")

    def _supported(self, path: str, kind: T.DataType, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise LoomError("E2315", f"{self.name}.{path}")
        if isinstance(kind, T.ArrayType):
            self._supported(f"{path}[]", kind.elementType, depth + 1)
        elif isinstance(kind, T.StructType):
            if not kind.fields:
                raise LoomError("E2315", f"{self.name}.{path}")
            for f in kind.fields:
                self._supported(f"{path}.{f.name}", f.dataType, depth + 1)
        elif not isinstance(kind, LEAVES) and not (isinstance(kind, T.DecimalType) and kind.scale == 0):
            raise LoomError("E2307", f"{self.name}.{path}: {kind.simpleString()}")

    def check(self, rows: DataFrame) -> DataFrame:
        """The declared columns in order; missing ones and other types are refused."""
        for f in self.schema.fields:
            if f.name not in rows.columns:
                raise LoomError("E2207", f"{self.name}.{f.name}")
            if rows.schema[f.name].dataType != f.dataType:
                raise LoomError("E2208", f"{self.name}.{f.name}: {rows.schema[f.name].dataType.simpleString()}")
        return rows.select(*self.schema.names)

    def checked(self, rows: DataFrame, over: Range | None = None) -> DataFrame:
        """`check`, and every value: none where null isn't declared, no date before 1970, block numbers within `over`."""
        tests: list[tuple[Column, str]] = [(F.col(self.number).isNotNull(), f"E2312 {self.name}.{self.number}")]
        if over is not None:
            inside = F.col(self.number) >= over.low if over.high is None else F.col(self.number).between(over.low, over.high)
            tests.append((inside, f"E2312 {self.name}.{self.number} outside of its batch"))
        for f in self.schema.fields:
            if not f.nullable:
                tests.append((F.col(f.name).isNotNull(), f"E2313 {self.name}.{f.name} is null"))
            if isinstance(f.dataType, T.DateType):
                tests.append((F.col(f.name).isNull() | (F.col(f.name) >= F.lit("1970-01-01").cast("date")), f"E2313 {self.name}.{f.name} is before 1970"))
        wrong = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for ok, what in tests])
        passed = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col(self.number)).cast(self.schema[self.number].dataType)
        return self.check(rows).withColumn(self.number, passed)


def declared_once(declared: Sequence[Table]) -> dict[str, Table]:
    if not declared:
        raise LoomError("E2301")
    names = [t.name for t in declared]
    for name in names:
        if names.count(name) > 1:
            raise LoomError("E2302", name)
    return {t.name: t for t in declared}


class CursorKey:
    """What a state is kept under: an explicit id, else the pipe's id once it is known, else the one of old."""

    LEGACY = "stream"

    def __init__(self, explicit: str | None = None):
        self.explicit, self.value = explicit is not None, explicit or self.LEGACY

    def bind(self, pipe_id: str | None) -> None:
        if not self.explicit and pipe_id:
            self.value = pipe_id


@dataclass
class Hooks:
    """Called by a sink: once before its first batch, around forks and recoveries (with the reason and the safe block)."""

    on_start: Callable[[Sink], None] | None = None
    on_before_rollback: Callable[[str, Cursor | None], None] | None = None
    on_after_rollback: Callable[[str, Cursor | None], None] | None = None


class Sink:
    """Common to all: declared tables, state, hooks, and forks. Subclasses give state, _append, _roll_back and _recover.

    bounded: a fork deletes up to the highest canonical block, so canonical blocks below the cursor are refused.
    """

    bounded = False

    def __init__(self, spark: SparkSession, declared: Sequence[Table] = (), unknown: str = "E2308", hooks: Hooks | None = None, state_id: str | None = None):
        self.spark, self.tables, self._unknown = spark, declared_once(declared), unknown
        self.hooks, self.key = hooks or Hooks(), CursorKey(state_id)
        self._started = self._clean = False

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise LoomError(self._unknown, name)
        return self.tables[name]

    def bind(self, pipe_id: str | None) -> None:
        """Takes the pipe's id as the key of the state, before the first batch."""
        self.key.bind(pipe_id)

    def state(self) -> PipeState:
        raise NotImplementedError

    def recover(self) -> None:
        """Takes back what a stopped batch left. Called before the first batch and after one that failed."""
        self._call(self.hooks.on_before_rollback, "recovery")
        self._recover()
        self._call(self.hooks.on_after_rollback, "recovery")
        self._clean = True

    def _call(self, hook: Callable | None, reason: str, safe: Cursor | None = None) -> None:
        if hook:
            hook(reason, self.state().cursor if reason == "recovery" else safe)

    def ready(self) -> PipeState:
        """Starts and recovers if that is due; the state to go on from."""
        if not self._started:
            if self.hooks.on_start:
                self.hooks.on_start(self)
            self._started = True
        if not self._clean:
            self.recover()
        return self.state()

    def write(self, rows: Mapping[str, DataFrame], blocks: Sequence[Cursor], finalized: Cursor | None, applied: int | None = None) -> PipeState:
        """applied: the number of the response that ends with these blocks."""
        for name in rows:
            self.table(name)
        now = self.ready()
        if blocks and now.cursor is not None and blocks[-1].number <= now.cursor.number:
            return now
        after = after_response(now.advance(blocks, finalized), applied)
        self._clean = False
        self._append(rows, blocks, after)
        self._clean = True
        return after

    def fork(self, canonical: Sequence[Cursor], applied: int | None = None) -> PipeState:
        """Goes back to the common ancestor and returns the state to go on from."""
        now = self.ready()
        safe = ancestor([Record(now.chain, now.finalized)], canonical, now.cursor if self.bounded else None)
        self._call(self.hooks.on_before_rollback, "fork", safe)
        self._clean = False
        upper = max([safe.number, *(b.number for b in canonical), *([now.cursor.number] if now.cursor else [])])
        after = after_response(now.rolled_back(safe), applied)
        self._roll_back(safe, upper, after)
        self._clean = True
        self._call(self.hooks.on_after_rollback, "fork", safe)
        return after

    def finish(self) -> PipeState:
        """At the end of a stream or a range."""
        return self.state()

    def _recover(self) -> None:
        pass

    def _append(self, rows: Mapping[str, DataFrame], blocks: Sequence[Cursor], after: PipeState) -> None:
        raise NotImplementedError

    def _roll_back(self, safe: Cursor, upper: int, after: PipeState) -> None:
        raise LoomError("E1001")


class FileSink(Sink):
    """State and the names of folders in a manifest below `path`; states by key, for several pipes may share a place."""

    def __init__(self, spark: SparkSession, path: str, declared: Sequence[Table], unknown: str = "E2308", hooks: Hooks | None = None, state_id: str | None = None):
        super().__init__(spark, declared, unknown, hooks, state_id)
        self.path, self.manifest = path, Manifest(spark, path)

    def state(self) -> PipeState:
        states = self.manifest.read().get("states", {})
        found = states.get(self.key.value) or (None if self.key.explicit else states.get(CursorKey.LEGACY))
        return load_state(found) if found else PipeState()

    def _commit(self, known: dict, after: PipeState, **changes) -> None:
        """One version: the state under this key (one of old goes over to it) and what has changed."""
        states = dict(known.get("states", {}))
        if not self.key.explicit:
            states.pop(CursorKey.LEGACY, None)
        self.manifest.commit(known | changes | {"states": states | {self.key.value: dump_state(after)}})

    def _read(self, folders: Sequence[str], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _save(self, df: DataFrame, name: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _folders(self, known: dict | None = None) -> dict[str, list[str]]:
        """Of each table the folders that count."""
        return {n: list((self.manifest.read() if known is None else known).get("folders", {}).get(n, [])) for n in self.tables}

    def rows(self, name: str) -> DataFrame:
        return self._read(self._folders()[self.table(name).name], self.tables[name].schema)

    def _strays(self, *named: str) -> None:
        """Deletes data folders that no version names."""
        kept = {f.split("/")[0] for f in named}
        for folder in self.manifest.folders(""):
            if not folder.startswith(("_versions", ".")) and folder not in kept:
                self.manifest.delete(folder)


class MemorySink(Sink):
    """Calls `deliver(table, rows)` with final rows; rows above the floor wait in tables below `path`."""

    def __init__(self, spark: SparkSession, deliver: Callable[[str, DataFrame], None], path: str, declared: Sequence[Table], hooks: Hooks | None = None):
        super().__init__(spark, declared, hooks=hooks)
        self.deliver, self.now = deliver, PipeState()
        self.held = {t.name: HoldBack(spark, f"{path}/{t.name}-{uuid.uuid4().hex}", t.schema, t.number) for t in declared}

    def state(self) -> PipeState:
        return self.now

    def _append(self, rows, blocks, after):
        floor = None if after.finalized is None else after.finalized.number
        next_held = {}
        for name, table in self.tables.items():
            part = table.check(rows[name]) if name in rows else self.spark.createDataFrame([], table.schema)
            final, next_held[name] = self.held[name].push(part, floor)
            self.deliver(name, final)
        self.held, self.now = next_held, after

    def _roll_back(self, safe, upper, after):
        self.held = {n: h.drop_above(safe.number) for n, h in self.held.items()}
        self.now = after


@dataclass
class Rotation:
    """When a segment is published: any of so many blocks, final rows, bytes on disk, or seconds since the last one."""

    blocks: int | None = 1
    rows: int | None = None
    bytes: int | None = None
    seconds: float | None = None


class SegmentSink(FileSink):
    """Final rows as Parquet folders `<table>/<from>-<to>` (12 digits), tiling the blocks from the first one on.

    A folder without rows says that those blocks have none; a missing one that they weren't read. Of `ranges` only blocks
    inside them are read, so a segment starts at the next of those. `encode` writes rows to a path (Spark's Parquet writer by
    default); names, checks and recovery stay here.
    """

    def __init__(self, spark: SparkSession, path: str, declared: Sequence[Table], start: int = 0, min_blocks: int = 1, rotation: Rotation | None = None, ranges: Sequence[Range] = (), encode: Callable[[DataFrame, str], None] | None = None, clock: Callable[[], float] = time.time, **options):
        super().__init__(spark, path, declared, **options)
        self.start, self.rotation, self.ranges, self.clock = start, rotation or Rotation(min_blocks), list(ranges), clock
        self.encode = encode or (lambda df, to: df.write.mode("overwrite").parquet(to))
        self._published = clock()

    def rows(self, name: str) -> DataFrame:
        table = self.table(name)
        return self._read([f"{name}/{s}" for s in self.manifest.read().get("segments", {}).get(name, [])], table.schema)

    def _recover(self) -> None:
        """Deletes segments and waiting rows that no version names; one that straddles the cursor is refused before anything is deleted."""
        known = self.manifest.read()
        covered = known.get("covered", self.start - 1)
        stray = [(n, s) for n in self.tables for s in self.manifest.folders(n) if s not in known.get("segments", {}).get(n, [])]
        for name, segment in stray:
            low, _, high = segment.partition("-")
            if low.isdigit() and high.isdigit() and int(low) <= covered < int(high):
                raise LoomError("E2317", f"{name}/{segment}")
        for name, segment in stray:
            self.manifest.delete(f"{name}/{segment}")
        named = {f.removeprefix("_pending/") for f in known.get("pending", {}).values()}
        for folder in self.manifest.folders("_pending"):
            if folder not in named:
                self.manifest.delete(f"_pending/{folder}")

    def finish(self) -> PipeState:
        """Publishes what is final, however little that is."""
        after = self.ready()
        self._clean = False
        self._append({}, (), after, force=True)
        self._clean = True
        return after

    def _due(self, known: dict, first: int, floor: int, waiting: Mapping[str, DataFrame]) -> bool:
        r = self.rotation
        if floor < first:
            return False
        if r.blocks is not None and floor - first + 1 >= r.blocks:
            return True
        if r.seconds is not None and self.clock() - self._published >= r.seconds:
            return True
        if r.bytes is not None and sum(self.manifest.size(f) for f in known.get("pending", {}).values()) >= r.bytes:
            return True
        return r.rows is not None and sum(x.where(F.col(self.tables[n].number) <= floor).count() for n, x in waiting.items()) >= r.rows

    def _append(self, rows, blocks, after, force=False):
        known = self.manifest.read()
        last = after.cursor.number if after.cursor else self.start - 1
        floor = last if after.finalized is None else min(after.finalized.number, last)
        covered, segments = known.get("covered", self.start - 1), {n: list(s) for n, s in known.get("segments", {}).items()}
        first = covered + 1
        if self.ranges:
            first = next_queried(self.ranges, first) if next_queried(self.ranges, first) is not None else first
        over = Range(blocks[0].number, blocks[-1].number) if blocks else None
        waiting = {}
        for name, t in self.tables.items():
            held = known.get("pending", {}).get(name)
            waiting[name] = self._read([held] if held else [], t.schema)
            if name in rows:
                waiting[name] = waiting[name].unionByName(t.checked(rows[name], over))
        publish = floor >= first if force else self._due(known, first, floor, waiting)
        if publish:
            self._check_range(first, floor)
        pending: dict[str, str] = {}
        name_of = f"{first:012d}-{floor:012d}"
        for name, t in self.tables.items():
            if publish:
                if name_of in segments.get(name, []):
                    raise LoomError("E2309", f"{name}/{name_of}")
                to = f"{self.path}/{name}/{name_of}"
                self.encode(waiting[name].where(F.col(t.number) <= floor), to)
                self._check_parquet(to, t)
                segments.setdefault(name, []).append(name_of)
            pending[name] = f"_pending/{name}-{uuid.uuid4().hex}"
            waiting[name].where(F.col(t.number) > floor if publish else F.lit(True)).write.parquet(f"{self.path}/{pending[name]}")
        self._commit(known, after, covered=floor if publish else covered, segments=segments, pending=pending)
        if publish:
            self._published = self.clock()
        for held in known.get("pending", {}).values():
            self.manifest.delete(held)

    @staticmethod
    def _check_range(low: int, high: int) -> None:
        if high < low:
            raise LoomError("E2316", f"{low}-{high}")

    def _check_parquet(self, path: str, t: Table) -> None:
        """What an encoder has written must be Parquet with the declared columns."""
        try:
            found = self.spark.read.parquet(path).schema
        except Exception as e:  # Spark's errors for missing and foreign files
            raise LoomError("E2320", path) from e
        if [(f.name, f.dataType) for f in found.fields] != [(f.name, f.dataType) for f in t.schema.fields]:
            raise LoomError("E2320", f"{path}: {found.simpleString()}")

    def _roll_back(self, safe, upper, after):
        known, pending = self.manifest.read(), {}
        for name, t in self.tables.items():
            if held := known.get("pending", {}).get(name):
                pending[name] = f"_pending/{name}-{uuid.uuid4().hex}"
                self._read([held], t.schema).where(F.col(t.number) <= safe.number).write.parquet(f"{self.path}/{pending[name]}")
        self._commit(known, after, pending=pending)
        for held in known.get("pending", {}).values():
            self.manifest.delete(held)


class SignedSink(FileSink):
    """Rows with a sign, appended as they come; a fork appends their cancellation."""

    def __init__(self, spark: SparkSession, path: str, declared: Sequence[Table], sign: str = "sign", **options):
        super().__init__(spark, path, declared, **options)
        for t in declared:
            if sign not in t.schema.names:
                raise LoomError("E2005", t.name)
        self.sign = sign

    def raw(self, name: str) -> DataFrame:
        return super().rows(name)

    def rows(self, name: str) -> DataFrame:
        """What is left after cancellation, a row for each."""
        columns = [c for c in self.table(name).schema.names if c != self.sign]
        left = tables.collapsed(self.raw(name), columns, self.sign)
        return left.select(*columns, F.explode(F.sequence(F.lit(1), F.col("balance").cast("int"))).alias("_copy")).drop("_copy")

    def _recover(self) -> None:
        self._strays(*(f for fs in self._folders().values() for f in fs))

    def _add(self, parts: Mapping[str, DataFrame], after: PipeState) -> None:
        known = self.manifest.read()
        folders = self._folders(known)
        for name, part in parts.items():
            folders[name].append(self._save(part, name))
        self._commit(known, after, folders=folders)

    def _append(self, rows, blocks, after):
        self._add({n: self.tables[n].check(part) for n, part in rows.items()}, after)

    def _roll_back(self, safe, upper, after):
        self._add({n: tables.cancel_rows(self.raw(n), F.col(t.number) > safe.number, self.sign) for n, t in self.tables.items()}, after)

    def remove(self, name: str, where: Column) -> None:
        """Removes rows as the table's engine allows: rows of a sign cancel others, plain rows are left out of a new copy."""
        t, known = self.table(name), self.manifest.read()
        self.ready()
        if t.engine == "distributed":
            raise LoomError("E2003", name)
        if t.engine == "collapsing" and t.collapse not in (None, self.sign):
            raise LoomError("E2004", f"{name} collapses by {t.collapse}")
        self._clean = False
        if t.engine == "collapsing":
            self._add({name: tables.cancel_rows(self.raw(name), where, self.sign)}, self.state())
        else:
            folders = self._folders(known) | {name: [self._save(self.raw(name).where(~F.coalesce(where, F.lit(False))), name)]}
            self._commit(known, self.state(), folders=folders)
        self._clean = True

    def cancel(self, name: str, rows: DataFrame) -> None:
        """Every one of these rows again with sign -1, whatever the engine."""
        self.ready()
        self._clean = False
        self._add({self.table(name).name: tables.cancel_query(self.tables[name].check(rows), self.sign)}, self.state())
        self._clean = True


class TableSink(FileSink):
    """Keyed tables: upserts and deletes by batch, undone after a fork. Data, undo records and state change in one version.

    A batch's rows may carry `operation` (`UPSERT` or `DELETE`) and, where a key changes twice in one block, `position`, which orders these
    changes; without it they are refused. The newest change of a key counts. Each change above the floor is logged at its own row's block,
    with what the key was before, so a fork may go back to any block of a batch. Rows lie in `buckets` folders by their key; only those
    that a batch touches are rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, declared: Sequence[Table], buckets: int = 64, **options):
        super().__init__(spark, path, declared, "E2104", **options)
        for t in declared:
            if not t.keys:
                raise LoomError("E2105", t.name)
        self.buckets = buckets

    def rows(self, name: str) -> DataFrame:
        data = self.manifest.read().get("data", {}).get(name, {})
        return self._read(sorted(set(data.values())), self.table(name).schema)

    def _bucket(self, t: Table) -> Column:
        return F.pmod(F.xxhash64(*t.keys), F.lit(self.buckets)).cast("int").alias("_bucket")

    @staticmethod
    def _undo_schema(t: Table) -> T.StructType:
        nullable = [T.StructField(f.name, f.dataType) for f in t.schema.fields]
        return T.StructType([*nullable, T.StructField("operation", T.StringType()), T.StructField("changed_at", T.LongType())])

    def _recover(self) -> None:
        known = self.manifest.read()
        self._strays(*(f for by in known.get("data", {}).values() for f in by.values()), *known.get("undo", {}).values())

    def _touched(self, t: Table, data: Mapping[str, str], changed: DataFrame) -> tuple[list[str], DataFrame]:
        """(buckets that the changed keys fall into, their rows now); at most `buckets` numbers come to the driver."""
        hit = sorted(str(r[0]) for r in changed.select(self._bucket(t)).distinct().collect())
        return hit, self._read([data[b] for b in hit if b in data], t.schema)

    def _rewritten(self, t: Table, data: Mapping[str, str], hit: Sequence[str], rows: DataFrame) -> dict[str, str]:
        """The data with these buckets replaced by the rows."""
        if not hit:
            return dict(data)
        folder = f"{t.name}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(t)).repartition(min(len(hit), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {f.partition("=")[2] for f in self.manifest.folders(folder) if f.startswith("_bucket=")}
        return {b: f for b, f in data.items() if b not in hit} | {b: f"{folder}/_bucket={b}" for b in hit if b in there}

    def _append(self, rows, blocks, after):
        known = self.manifest.read()
        data, undo = dict(known.get("data", {})), dict(known.get("undo", {}))
        reachable = after.finalized is not None and bool(blocks) and blocks[-1].number > after.finalized.number
        for name, part in rows.items():
            t = self.table(name)
            given = self._changes(t, part).persist()
            try:
                keys = list(t.keys)
                changed = given.select(*keys).distinct()
                hit, old = self._touched(t, data.get(name, {}), changed)
                if reachable:
                    log = self._read([undo[name]] if name in undo else [], self._undo_schema(t)).where(F.col("changed_at") > after.finalized.number)
                    images = self._images(t, given, old).where(F.col("changed_at") > after.finalized.number)
                    undo[name] = self._save(log.unionByName(images), f"_undo-{name}")
                newest = given.groupBy(*keys).agg(F.max_by(F.struct(*given.columns), F.col(t.number)).alias("_row")).select("_row.*")
                fresh = t.check(newest.where("operation <> 'DELETE'").select(*t.schema.names))
                data[name] = self._rewritten(t, data.get(name, {}), hit, old.join(changed, keys, "left_anti").unionByName(fresh))
            finally:
                given.unpersist()
        self._swap(known, after, data, undo)

    @staticmethod
    def _changes(t: Table, part: DataFrame) -> DataFrame:
        """The last change of each key in each block."""
        given = part if "operation" in part.columns else part.withColumn("operation", F.lit("UPSERT"))
        keys = [*t.keys, t.number]
        place = F.col("position") if "position" in part.columns else F.lit(0)
        row = F.struct(*t.schema.names, "operation")
        found = given.withColumn("_at", place).groupBy(*keys).agg(F.max_by(row, "_at").alias("_row"), F.count("*").alias("_n"), F.count_distinct("_at").alias("_places"))
        if not (tied := found.where("_n > _places").limit(1)).isEmpty():
            raise LoomError("E2319", f"{t.name}: {tied.select(*keys).first()}")
        return found.select("_row.*")

    @staticmethod
    def _images(t: Table, given: DataFrame, old: DataFrame) -> DataFrame:
        """What each changed key was before each of its changes: an INSERT record where it wasn't there."""
        keys, columns = list(t.keys), list(t.schema.names)
        before = F.lag(F.struct(*columns, "operation")).over(Window.partitionBy(*keys).orderBy(t.number))
        steps = given.select(*keys, F.col(t.number).cast("long").alias("changed_at"), before.alias("_before"))
        stored = old.select(*keys, F.struct(*columns, F.lit("UPSERT").alias("operation")).alias("_stored"))
        was = F.coalesce("_before", "_stored")
        found = steps.join(stored, keys, "left").withColumn("_was", was).withColumn("_there", F.col("_was").isNotNull() & (F.col("_was.operation") != "DELETE"))
        fields = [F.col(c) if c in keys else F.when(F.col("_there"), F.col(f"_was.{c}")).alias(c) for c in columns]
        return found.select(*fields, F.when(F.col("_there"), "UPDATE").otherwise("INSERT").alias("operation"), "changed_at")

    def _swap(self, known: dict, after: PipeState, data: dict, undo: dict) -> None:
        self._commit(known, after, data=data, undo=undo)
        named = lambda d, u: {f for by in d.values() for f in by.values()} | set(u.values())
        for folder in named(known.get("data", {}), known.get("undo", {})) - named(data, undo):
            self.manifest.delete(folder)

    def _roll_back(self, safe, upper, after):
        known = self.manifest.read()
        data, undo = dict(known.get("data", {})), dict(known.get("undo", {}))
        for name, folder in list(undo.items()):
            t = self.table(name)
            log, keys = self._read([folder], self._undo_schema(t)), list(t.keys)
            images = tables.first_images(log, keys, safe.number, "changed_at").persist()
            try:
                hit, old = self._touched(t, data.get(name, {}), images.select(*keys))
                kept = old.join(images.select(*keys), keys, "left_anti")
                data[name] = self._rewritten(t, data.get(name, {}), hit, kept.unionByName(images.where("operation <> 'INSERT'").select(*t.schema.names)))
            finally:
                images.unpersist()
            undo[name] = self._save(log.where(F.col("changed_at") <= safe.number), f"_undo-{name}")
        self._swap(known, after, data, undo)


class WriteAheadSink(FileSink):
    """Append-only tables in folders by block bucket; an intent with the block range precedes each append.

    An intent that is still open says that a batch stopped: no batch is taken before `recover` has closed it. Without
    a state no table may have rows, as they would be somebody else's.
    """

    BUCKET, bounded = 10_000, True

    def __init__(self, spark: SparkSession, path: str, declared: Sequence[Table], **options):
        super().__init__(spark, path, declared, "E2209", **options)

    def _recover(self) -> None:
        known = self.manifest.read()
        if not known and any(self.manifest.folders(n) for n in self.tables):
            raise LoomError("E2212")
        named = {n: set(fs) for n, fs in self._folders(known).items()}
        for name in self.tables:
            for folder in self.manifest.folders(name):
                if f"{name}/{folder}" not in named[name]:
                    self.manifest.delete(f"{name}/{folder}")
        if known.get("intent"):
            self._commit(known, self.state(), intent=None)

    def _intend(self, low: int, high: int) -> dict:
        known = self.manifest.read()
        if known.get("intent"):
            raise RuntimeError(f"the intent {known['intent']} is open")
        self._commit(known, self.state(), intent=[low, high])
        return self.manifest.read()

    def _append(self, rows, blocks, after):
        if not blocks:
            return self._commit(self.manifest.read(), after)
        known = self._intend(blocks[0].number, blocks[-1].number)
        folders = self._folders(known)
        buckets = range(blocks[0].number // self.BUCKET, blocks[-1].number // self.BUCKET + 1)
        for name, part in rows.items():
            t = self.tables[name]
            checked = t.checked(part, Range(blocks[0].number, blocks[-1].number))
            for bucket in buckets:
                folders[name].append(self._save(checked.where(F.floor(F.col(t.number) / self.BUCKET) == bucket), f"{name}/bucket={bucket}"))
        self._commit(known, after, folders=folders, intent=None)

    def _roll_back(self, safe, upper, after):
        known = self._intend(safe.number + 1, max(upper, safe.number + 1))
        folders, gone = self._without(known, safe.number + 1, upper)
        self._commit(known, after, folders=folders, intent=None)
        for folder in gone:
            self.manifest.delete(folder)

    def _without(self, known: dict, low: int, high: int) -> tuple[dict[str, list[str]], list[str]]:
        """(folders that hold what is left without blocks in [low, high], folders that they replace); other buckets stay."""
        folders, gone = self._folders(known), []
        for name, t in self.tables.items():
            for folder in list(folders[name]):
                bucket = int(folder.partition("=")[2].partition("-")[0])
                part = self._read([folder], t.schema)
                if low // self.BUCKET <= bucket <= high // self.BUCKET and not part.where(F.col(t.number).between(low, high)).isEmpty():
                    folders[name].remove(folder)
                    folders[name].append(self._save(part.where(~F.col(t.number).between(low, high)), f"{name}/bucket={bucket}"))
                    gone.append(folder)
        return folders, gone


@dataclass
class FunctionSink(Sink):
    """A sink of two functions: write(rows, blocks, finalized, state before) and, if it can, resolve(canonical) -> the safe block."""

    spark: SparkSession
    append: Callable[[Mapping[str, DataFrame], Sequence[Cursor], Cursor | None, PipeState], None]
    resolve: Callable[[Sequence[Cursor]], Cursor | None] | None = None
    now: PipeState = field(default_factory=PipeState)
    tables: dict = field(default_factory=dict)

    def bind(self, pipe_id: str | None) -> None:
        pass

    def state(self) -> PipeState:
        return self.now

    def ready(self) -> PipeState:
        return self.now

    def write(self, rows, blocks, finalized, applied=None):
        if not (blocks and self.now.cursor is not None and blocks[-1].number <= self.now.cursor.number):
            if blocks or finalized:
                self.append(rows, blocks, finalized, self.now)
            self.now = after_response(self.now.advance(blocks, finalized), applied)
        return self.now

    def fork(self, canonical, applied=None):
        if self.resolve is None:
            raise LoomError("E1001")
        if not canonical:
            raise LoomError("E1002")
        safe = self.resolve(canonical)
        if safe is None:
            raise LoomError("E1003")
        self.now = after_response(self.now.rolled_back(safe), applied)
        return self.now
