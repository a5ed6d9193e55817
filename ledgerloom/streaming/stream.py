"""Streams of recorded responses, pipes of transformers over them, and what drives a sink from a stream.

A recorded log is a folder of files with one JSON line for each response: seq (1, 2, 3, ...), status (200 blocks, 204 a head alone, 409 a fork,
others that ask to try again), finalized_number, finalized_hash, latest_number, bytes, blocks in the schema of a network and, for a
fork, previous_blocks. Spark's own file source reads them, so offsets and the number of files for each micro-batch survive a restart.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import LoomError
from ledgerloom.operators.tables import progress
from ledgerloom.plans.query import Query
from ledgerloom.sinks.targets import Sink
from ledgerloom.sources import schemas

from .finality import Cursor, highest

#: Waits in seconds before a failed request is tried again; the last one from then on (fixed values).
RETRY_SECONDS = (0.01, 0.1, 0.5, 2, 10, 20)
#: Statuses that are tried again, besides any answer that says when (fixed values).
RETRIED = {429, 502, 503, 504, 521, 522, 523, 524}


def with_retries(call: Callable[[], tuple[int, Any]], wait: Callable[[float], None] = time.sleep, most: int | None = None) -> tuple[int, Any]:
    """Calls until the status isn't one to try again; connection errors count as such. `most` limits the tries."""
    tries = 0
    while True:
        try:
            status, body = call()
        except (ConnectionError, TimeoutError):
            if most is not None and tries + 1 >= most:
                raise
            status, body = 503, None
        if status not in RETRIED or (most is not None and tries + 1 >= most):
            return status, body
        wait(RETRY_SECONDS[min(tries, len(RETRY_SECONDS) - 1)])
        tries += 1


def response_schema(network: str, selection: schemas.Selection | None = None) -> str:
    full = schemas.schema(network)
    chosen = full if selection is None else schemas.project(full, schemas.merge_fields({"header": {"number": True, "hash": True, "timestamp": True}}, selection))
    return (
        "seq BIGINT, status INT, finalized_number BIGINT, finalized_hash STRING, latest_number BIGINT, bytes BIGINT, "
        f"blocks ARRAY<{chosen.simpleString()}>, previous_blocks ARRAY<STRUCT<number: BIGINT, hash: STRING>>"
    )


def responses(spark: SparkSession, path: str, network: str, selection: schemas.Selection | None = None, files: int | None = None) -> DataFrame:
    """The recorded responses below `path` as a stream, `files` of them in a micro-batch at most."""
    stream = spark.readStream.schema(response_schema(network, selection)).option("mode", "FAILFAST")
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).json(path)


@dataclass
class Progress:
    """What a pipe has done so far, from what its micro-batches tell the driver."""

    id: str
    start: int = 0
    processed: int = -1
    latest: int = -1
    blocks: int = 0
    bytes: int = 0
    forks: int = 0
    requests: dict[int, int] = field(default_factory=dict)
    decode_errors: dict[str, int] = field(default_factory=dict)

    def request(self, status: int, size: int | None, latest: int | None) -> None:
        self.requests[status] = self.requests.get(status, 0) + 1
        self.bytes += size or 0
        self.latest = max(self.latest, -1 if latest is None else latest)

    def advanced(self, to: Cursor | None, blocks: int) -> None:
        self.processed, self.blocks = -1 if to is None else to.number, self.blocks + blocks

    def rows(self, spark: SparkSession, seconds: float) -> DataFrame:
        """(id, metric, label, value): totals, ratio and estimated time; -1 is a block that isn't known yet."""
        last = max(self.latest, self.processed)
        base = spark.createDataFrame([(self.id, self.start, self.processed, last, float(self.blocks), seconds)], "id string, initial long, current long, last long, blocks double, seconds double")
        found = progress(base, F.col("blocks") / F.col("seconds")).select("id", F.explode(F.map_from_arrays(F.array(F.lit("progress_ratio"), F.lit("eta_seconds")), F.array(F.col("percent") / 100, F.col("eta_seconds")))).alias("metric", "value"))
        plain = [("processed_block", None, self.processed), ("end_block", None, last), ("blocks_processed_total", None, self.blocks), ("bytes_downloaded_total", None, self.bytes), ("forks_total", None, self.forks)]
        plain += [("requests_total", str(s), n) for s, n in sorted(self.requests.items())] + [("decode_errors_skipped_total", k, n) for k, n in sorted(self.decode_errors.items())]
        counted = spark.createDataFrame([(self.id, m, label, float(v)) for m, label, v in plain], "id string, metric string, label string, value double")
        return counted.unionByName(found.withColumn("label", F.lit(None).cast("string")))


Rows = Callable[[DataFrame], Mapping[str, DataFrame]]


def apply_responses(
    frame: DataFrame,
    network: str,
    sink: Sink,
    rows_of: Rows,
    after_fork: Callable[[Cursor], None] | None = None,
    progress_of: Progress | None = None,
    finalized_only: bool = False,
    per_block: bool = False,
) -> None:
    """Applies responses to a sink in order; the driver holds what identifies blocks. A response that is missing is an error.

    All blocks between two forks are one batch, or, with `per_block`, all final ones and then each of the others. rows_of turns
    blocks into rows by table. Responses that the sink's state holds already are passed over, and blocks up to its cursor left out.
    finalized_only leaves blocks above the finalized head for later responses.
    """
    heads = F.transform("blocks", lambda b: F.struct(b["header"]["number"].alias("number"), b["header"]["hash"].alias("hash"), b["header"]["timestamp"].alias("timestamp")))
    control = frame.select("seq", "status", "finalized_number", "finalized_hash", "latest_number", "bytes", heads.alias("heads"), "previous_blocks").orderBy("seq")
    tell = progress_of or Progress("")
    waiting: list = []

    def flush() -> None:
        if not waiting:
            return
        head = highest([Cursor(r.finalized_number, r.finalized_hash) for r in waiting if r.finalized_number is not None])
        now = sink.ready()
        listed = {b.number: Cursor(b.number, b.hash, b.timestamp) for r in waiting for b in r.heads or []}
        new = [listed[k] for k in sorted(listed) if (now.cursor is None or k > now.cursor.number) and not (finalized_only and (head is None or k > head.number))]
        inside = frame.where(F.col("seq").between(waiting[0].seq, waiting[-1].seq) & F.col("status").isin(200, 204)).select(F.explode("blocks").alias("b")).select("b.*")
        rises = head is not None and (now.finalized is None or head.number > now.finalized.number)
        floor = max([x.number for x in (head, now.finalized) if x is not None], default=None)
        parts = [new]
        if per_block and floor is not None:
            parts = [[b for b in new if b.number <= floor], *([b] for b in new if b.number > floor)]
        todo = [p for p in parts if p] or ([[]] if rises else [])
        for k, part in enumerate(todo, 1):
            number = F.col("header.number")
            own = inside.where(number.between(part[0].number, part[-1].number) if part else F.lit(False)).dropDuplicates(["header"] if part else [])
            after = sink.write(rows_of(schemas.normalized(own, network)), part, head, waiting[-1].seq if k == len(todo) else None)
            tell.advanced(after.cursor, len(part))
        waiting.clear()

    last: int | None = None
    for r in control.toLocalIterator():
        if last is None:
            last = sink.ready().applied
        if r.seq <= last:
            continue
        if r.seq != last + 1:
            raise RuntimeError(f"response {r.seq} came after {last}")
        last = r.seq
        tell.request(r.status, r.bytes, r.latest_number)
        if r.status == 409:
            flush()
            state = sink.fork([Cursor(b.number, b.hash) for b in r.previous_blocks or []], r.seq)
            tell.forks += 1
            tell.advanced(state.cursor, 0)
            if after_fork and state.cursor:
                after_fork(state.cursor)
        elif r.status in (200, 204):
            waiting.append(r)
        elif r.status not in RETRIED:
            raise RuntimeError(f"response {r.seq} has status {r.status}")
    flush()
    if last is not None and last > sink.state().applied:
        sink.write({}, [], None, last)


@dataclass(frozen=True)
class Transformer:
    """A step of a pipe: rows by table to rows by table. `setup` adds to the query before the start; hooks run on the driver."""

    transform: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]] = dict
    id: str = "step"
    setup: Callable[[Query], Query] | None = None
    start: Callable[[], None] | None = None
    rollback: Callable[[Cursor], None] | None = None
    stop: Callable[[], None] | None = None
    children: tuple[Transformer, ...] = ()

    def all(self) -> Iterator[Transformer]:
        yield self
        for child in self.children:
            yield from child.all()

    def apply(self, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out = dict(self.transform(rows))
        for child in self.children:
            out = child.apply(out)
        return out


@dataclass(frozen=True)
class Pipe:
    """A query and the steps after it; each call returns a new pipe."""

    id: str
    query: Query
    steps: tuple[Transformer, ...] = ()

    def pipe(self, step: Transformer | Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]]) -> Pipe:
        """With one more step; ids that are taken get a number."""
        made = step if isinstance(step, Transformer) else Transformer(step)
        taken, name, n = {s.id for s in self.steps}, made.id, 2
        while name in taken:
            name, n = f"{made.id}-{n}", n + 1
        return replace(self, steps=(*self.steps, replace(made, id=name)))

    def planned(self) -> Query:
        """The query with what the steps add to it."""
        query = self.query
        for t in self._all():
            query = t.setup(query) if t.setup else query
        return query

    def _all(self) -> list[Transformer]:
        return [t for s in self.steps for t in s.all()]

    def rows(self, blocks: DataFrame) -> dict[str, DataFrame]:
        out = self.planned().run(blocks)
        for step in self.steps:
            out = step.apply(out)
        return out

    def batches(self, spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
        return responses(spark, path, self.query.network, files=files)

    def run_to(self, spark: SparkSession, path: str, sink: Sink, checkpoint: str, files: int | None = None, told: Progress | None = None, **options: Any) -> None:
        """Reads what the log holds now into the sink. Steps start before the first batch and stop once, however it ends."""
        if not self.id:
            raise LoomError("E0001")
        sink.bind(self.id)
        steps = self._all()
        back = lambda cursor: [t.rollback(cursor) for t in steps if t.rollback]
        keep = lambda rows: {n: r for n, r in rows.items() if n in sink.tables or not sink.tables}
        try:
            for t in steps:
                if t.start:
                    t.start()
            start(self.batches(spark, path, files), self.query.network, sink, lambda blocks: keep(self.rows(blocks)), checkpoint, after_fork=back, progress_of=told, **options).awaitTermination()
        finally:
            for t in steps:
                if t.stop:
                    t.stop()


def start(stream: DataFrame, network: str, sink: Sink, rows_of: Rows, checkpoint: str, **options: Any):
    """A streaming query from responses to the sink; it ends when what the log holds now is read."""

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()
        try:
            apply_responses(kept, network, sink, rows_of, **options)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_pipes(pipes: Mapping[str, Callable[[], Any]], retries: int = 5) -> None:
    """Starts all pipes (functions that return a streaming query) and restarts each that fails, so many times at most."""
    running, failed = {name: start_() for name, start_ in pipes.items()}, dict.fromkeys(pipes, 0)
    while running:
        for name, query in list(running.items()):
            if query.isActive:
                continue
            if query.exception() is None:
                del running[name]
                continue
            failed[name] += 1
            if failed[name] > (retries or 5):
                raise RuntimeError(f"pipe {name} failed {failed[name]} times") from query.exception()
            running[name] = pipes[name]()
        time.sleep(0.05)
