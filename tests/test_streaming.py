import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import LoomError
from ledgerloom.sinks.manifest import Manifest
from ledgerloom.sinks.setup import delete_order, run_sql_files
from ledgerloom.plans.query import Query
from ledgerloom.plans.ranges import Range
from ledgerloom.sinks.targets import CursorKey, FunctionSink, Hooks, MemorySink, Rotation, SegmentSink, SignedSink, Table, TableSink, WriteAheadSink
from ledgerloom.streaming import finality
from ledgerloom.streaming.finality import Cursor, PipeState, Record
from ledgerloom.streaming.holdback import HoldBack
from ledgerloom.streaming.stream import Pipe, Progress, Transformer, responses, run_pipes, start, with_retries

BLOCKS = T.StructType([T.StructField("block_number", T.LongType()), T.StructField("hash", T.StringType())])


def c(text):
    """Cursors from `5 6a 7b`."""
    return [Cursor(int(x.rstrip("abc")), f"0x{x}") for x in text.split()]


@pytest.mark.parametrize(
    ("chain", "floor", "canonical", "expected"),
    [
        ("5 6 7", "4", "5 6a 7a", "5"),
        ("5a 6a", "4", "5b 6b", None),
        ("5a 6a", "4", "4 5b 6b", "4"),
        ("5 6 7", "4", "6", "6"),
        ("5 6 7", "3", "7a", "6"),
        ("3a", "5", "3b", None),
        ("5 6", "4", "10 11", "5"),
        ("7a", "5", "5 6b", None),
        ("", "4", "5 6", None),
    ],
)
def test_fork_resolution(chain, floor, canonical, expected):
    found = finality.resolve_fork([Record(tuple(c(chain)), c(floor)[0])], c(canonical))
    assert found == (c(expected)[0] if expected else None)


def test_fork_over_several_records():
    records = [Record(tuple(c("7a 8a")), c("4")[0]), Record(tuple(c("5 6")), c("4")[0])]
    assert finality.resolve_fork(records, c("5 6 7b 8b")) == c("6")[0]


def test_fork_errors():
    for canonical, cursor, code in (([], None, "E1002"), (c("5b"), c("5a")[0], "E1003"), (c("5"), c("7")[0], "E1004")):
        with pytest.raises(LoomError, match=code):
            finality.ancestor([Record(tuple(c("5a")), c("4")[0])], canonical, cursor)


def test_floor_never_falls():
    state = PipeState()
    for blocks, head, floor in (("1 2", "1", 1), ("3", None, 1), ("4", "0", 1), ("", "3", 3)):
        state = state.advance(c(blocks), c(head)[0] if head else None)
        assert state.finalized.number == floor
    assert [b.number for b in state.chain] == [4]
    with pytest.raises(ValueError, match="order"):
        state.advance(c("4"), None)


def frame(spark, text):
    return spark.createDataFrame([(b.number, b.hash) for b in c(text)], BLOCKS)


def hashes(df):
    return sorted(r.hash[2:] for r in df.collect())


def test_hold_back(spark, tmp_path):
    held = HoldBack(spark, str(tmp_path / "h"), BLOCKS)
    released, held = held.push(frame(spark, "1 2 3"), 1)
    assert hashes(released) == ["1"]
    released, held = held.push(frame(spark, "4"), 3)
    assert hashes(released) == ["2", "3"]
    held = held.drop_above(3)
    released, held = held.push(frame(spark, ""), 9)
    assert hashes(released) == []
    released, held = held.push(frame(spark, "5"), None)
    assert hashes(released) == ["5"]


def steps(sink, spark, rows_of):
    """Two batches, a fork that replaces 3 and 4, and the new chain up to its finality."""
    sink.write(rows_of("1 2"), c("1 2"), c("1")[0])
    sink.write(rows_of("3a"), c("3a"), c("1")[0])
    sink.write(rows_of("4a"), c("4a"), c("1")[0])
    assert sink.fork(c("2 3b 4b")).cursor == c("2")[0]
    sink.write(rows_of("3b"), c("3b"), c("2")[0])
    return sink.write(rows_of("4b"), c("4b"), c("3b")[0])


def test_memory_sink(spark, tmp_path):
    seen = []
    sink = MemorySink(spark, lambda name, rows: seen.extend(hashes(rows)), str(tmp_path), [Table("blocks", BLOCKS)])
    steps(sink, spark, lambda t: {"blocks": frame(spark, t)})
    assert seen == ["1", "2", "3b"]


def test_segment_sink(spark, tmp_path):
    path = str(tmp_path / "segments")
    declared = [Table("blocks", BLOCKS), Table("empty", BLOCKS)]
    steps(SegmentSink(spark, path, declared), spark, lambda t: {"blocks": frame(spark, t)})
    again = SegmentSink(spark, path, declared)
    frame(spark, "9").write.parquet(f"{path}/blocks/000000000004-000000000009")
    again.recover()
    assert hashes(again.rows("blocks")) == ["1", "2", "3b"]
    assert again.manifest.read()["segments"]["empty"] == [f"{a:012d}-{b:012d}" for a, b in ((0, 1), (2, 2), (3, 3))]
    assert again.manifest.folders("blocks") == again.manifest.read()["segments"]["blocks"]
    assert again.state().cursor.number == 4
    before = again.manifest.versions()
    again.write({"blocks": frame(spark, "4b")}, c("4b"), c("3b")[0])  # a batch that Spark runs again
    assert again.manifest.versions() == before
    frame(spark, "9").write.parquet(f"{path}/blocks/000000000002-000000000009")
    with pytest.raises(LoomError, match="E2317"):
        again.recover()
    again.manifest.delete("blocks/000000000002-000000000009")
    with pytest.raises(LoomError, match="E2308"):
        again.write({"other": frame(spark, "5")}, c("5"), None)


def test_segments_of_several_blocks(spark, tmp_path):
    sink = SegmentSink(spark, str(tmp_path / "s"), [Table("blocks", BLOCKS)], start=1, min_blocks=3)
    for k in range(1, 6):
        sink.write({"blocks": frame(spark, str(k))}, c(str(k)), c(str(k))[0])
    assert sink.manifest.read()["segments"]["blocks"] == ["000000000001-000000000003"]
    assert hashes(sink.rows("blocks")) == ["1", "2", "3"]
    sink.finish()
    assert sink.manifest.read()["segments"]["blocks"][1:] == ["000000000004-000000000005"]
    assert hashes(sink.rows("blocks")) == ["1", "2", "3", "4", "5"]


def test_signed_sink(spark, tmp_path):
    signed = T.StructType([*BLOCKS.fields, T.StructField("sign", T.IntegerType())])
    sink = SignedSink(spark, str(tmp_path / "signed"), [Table("blocks", signed)])
    rows_of = lambda t: {"blocks": frame(spark, t).withColumn("sign", F.lit(1))}
    steps(sink, spark, rows_of)
    assert hashes(sink.rows("blocks")) == ["1", "2", "3b", "4b"]
    assert sink.raw("blocks").count() == 8
    rows_of("5")["blocks"].write.parquet(f"{sink.path}/blocks-crashed")  # a crash before the state
    sink.recover()
    assert "blocks-crashed" not in sink.manifest.folders("")
    assert hashes(sink.rows("blocks")) == ["1", "2", "3b", "4b"]
    with pytest.raises(LoomError, match="E2005"):
        SignedSink(spark, str(tmp_path / "x"), [Table("blocks", BLOCKS)])


def test_table_sink_undoes_updates_inserts_and_deletes(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("block_number", T.LongType()), T.StructField("v", T.LongType())])
    sink = TableSink(spark, str(tmp_path / "t"), [Table("balances", schema, keys=("k",))])
    batch = lambda *rows: {"balances": spark.createDataFrame([(k, n, v, op) for k, n, v, op in rows], "k string, block_number long, v long, operation string")}
    state = lambda: sorted((r.k, r.v) for r in sink.rows("balances").collect())
    sink.write(batch(("a", 1, 10, "UPSERT"), ("b", 1, 20, "UPSERT")), c("1"), c("1")[0])
    sink.write(batch(("a", 2, 11, "UPSERT")), c("2"), c("1")[0])
    sink.write(batch(("a", 3, 12, "UPSERT"), ("c", 3, 1, "UPSERT"), ("b", 3, 0, "DELETE")), c("3a"), c("1")[0])
    assert state() == [("a", 12), ("c", 1)]
    sink.fork(c("2 3b"))
    assert state() == [("a", 11), ("b", 20)]
    sink.write(batch(("d", 3, 5, "UPSERT")), c("3b"), c("3b")[0])
    assert state() == [("a", 11), ("b", 20), ("d", 5)]
    with pytest.raises(LoomError, match="E2105"):
        TableSink(spark, str(tmp_path / "x"), [Table("balances", schema)])


def test_table_sink_orders_the_changes_of_a_batch(spark, tmp_path):
    """Batches of several blocks, keys that change more than once, forks to every block: as a dictionary replayed block by block."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("block_number", T.LongType()), T.StructField("v", T.LongType())])
    batch = lambda *rows: {"balances": spark.createDataFrame(list(rows), "k string, block_number long, v long, operation string, position long")}
    first = [("x", 4, 1, "UPSERT", 0), ("z", 4, 9, "UPSERT", 0), ("gone", 4, 2, "UPSERT", 0)]
    second = [("x", 5, 2, "UPSERT", 0), ("y", 6, 3, "UPSERT", 0), ("x", 6, 4, "UPSERT", 1), ("x", 6, 5, "UPSERT", 2), ("z", 5, 0, "DELETE", 0), ("z", 6, 8, "UPSERT", 0), ("gone", 6, 0, "DELETE", 0), ("new", 5, 7, "UPSERT", 0), ("new", 5, 0, "DELETE", 1), ("new", 6, 6, "UPSERT", 0)]
    for safe in (4, 5, 6):
        sink = TableSink(spark, str(tmp_path / f"t{safe}"), [Table("balances", schema, keys=("k",))], buckets=4)
        sink.write(batch(*first), c("4"), c("4")[0])
        sink.write(batch(*second), c("5 6a"), c("4")[0])
        held = {}
        for k, n, v, op, _ in sorted(first + second, key=lambda r: (r[1], r[4])):
            if n <= safe:
                held.pop(k, None)
                if op == "UPSERT":
                    held[k] = (n, v)
        if safe < 6:
            sink.fork(c(f"{safe} 6b" if safe == 5 else "4 5b"))
        assert sorted((r.k, (r.block_number, r.v)) for r in sink.rows("balances").collect()) == sorted(held.items())
    with pytest.raises(LoomError, match="E2319"):
        sink.write({"balances": spark.createDataFrame([("q", 7, 1), ("q", 7, 2)], "k string, block_number long, v long")}, c("7"), c("4")[0])


def test_write_ahead_sink(spark, tmp_path):
    path = str(tmp_path / "w")
    sink = WriteAheadSink(spark, path, [Table("blocks", BLOCKS)])
    steps(sink, spark, lambda t: {"blocks": frame(spark, t)})
    assert hashes(sink.rows("blocks")) == ["1", "2", "3b", "4b"]
    sink.manifest.commit(sink.manifest.read() | {"intent": [5, 6]})  # a crash between rows and commit
    frame(spark, "5 6").write.parquet(f"{path}/blocks/bucket=0-crashed")
    with pytest.raises(RuntimeError, match="open"):
        sink.write({"blocks": frame(spark, "5 6")}, c("5 6"), c("3b")[0])
    again = WriteAheadSink(spark, path, [Table("blocks", BLOCKS)])
    again.recover()
    assert again.manifest.read()["intent"] is None and "bucket=0-crashed" not in again.manifest.folders("blocks")
    assert hashes(again.rows("blocks")) == ["1", "2", "3b", "4b"]
    frame(spark, "1").write.parquet(str(tmp_path / "orphan/blocks/bucket=0-x"))
    with pytest.raises(LoomError, match="E2212"):
        WriteAheadSink(spark, str(tmp_path / "orphan"), [Table("blocks", BLOCKS)]).recover()


def test_manifest_takes_one_writer(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    assert m.read() == {}
    assert [m.commit({"a": 1}), m.commit({"a": 2})] == [1, 2]
    assert (m.read(), m.read(1)) == ({"a": 2}, {"a": 1})


class Stopped(Exception):
    pass


def crash_scenario(monkeypatch, make, rows_of, at):
    """The steps of `steps`, stopped before the `at`-th save, commit or delete; then a new sink gets the same step again."""
    from ledgerloom.sinks import targets

    calls = {"n": 0}

    def counted(f):
        def run(*args, **kwargs):
            calls["n"] += 1
            if calls["n"] == at:
                raise Stopped
            return f(*args, **kwargs)

        return run

    for owner, name in ((Manifest, "commit"), (Manifest, "delete"), (targets.FileSink, "_save"), (targets.SegmentSink, "_check_parquet"), (targets.TableSink, "_rewritten")):
        monkeypatch.setattr(owner, name, counted(getattr(owner, name)))
    sink = make()
    todo = [
        lambda s: s.write(rows_of("1 2"), c("1 2"), c("1")[0]),
        lambda s: s.write(rows_of("3a"), c("3a"), c("1")[0]),
        lambda s: s.fork(c("2 3b")) if s.state().cursor.number == 3 and s.state().cursor.hash == "0x3a" else None,
        lambda s: s.write(rows_of("3b"), c("3b"), c("3b")[0]),
    ]
    for step in todo:
        try:
            step(sink)
        except Stopped:
            sink = make()
            step(sink)
    monkeypatch.undo()
    return calls["n"] >= at, sink


@pytest.mark.parametrize("kind", ["segment", "signed", "table", "ahead"])
def test_a_batch_that_stopped_anywhere_and_runs_again_counts_once(spark, tmp_path, monkeypatch, kind):
    signed = T.StructType([*BLOCKS.fields, T.StructField("sign", T.IntegerType())])
    rows_of = lambda t: {"blocks": frame(spark, t).withColumn("sign", F.lit(1)) if kind == "signed" else frame(spark, t)}
    at = 1
    while True:
        path = str(tmp_path / f"{kind}{at}")
        make = {
            "segment": lambda: SegmentSink(spark, path, [Table("blocks", BLOCKS)]),  # noqa: B023
            "signed": lambda: SignedSink(spark, path, [Table("blocks", signed)]),  # noqa: B023
            "table": lambda: TableSink(spark, path, [Table("blocks", BLOCKS, keys=("block_number",))], buckets=4),  # noqa: B023
            "ahead": lambda: WriteAheadSink(spark, path, [Table("blocks", BLOCKS)]),  # noqa: B023
        }[kind]
        stopped, sink = crash_scenario(monkeypatch, make, rows_of, at)
        assert hashes(sink.rows("blocks")) == ["1", "2", "3b"], at
        assert sink.state().cursor == c("3b")[0]
        if not stopped:
            break
        at += 1
    assert at > 4


def test_hooks_keys_and_old_states(spark, tmp_path):
    told, path = [], str(tmp_path / "s")
    old = SignedSink(spark, path, [Table("blocks", T.StructType([*BLOCKS.fields, T.StructField("sign", T.IntegerType())]))])
    rows_of = lambda t: {"blocks": frame(spark, t).withColumn("sign", F.lit(1))}
    old.write(rows_of("1 2"), c("1 2"), c("1")[0])
    assert list(old.manifest.read()["states"]) == [CursorKey.LEGACY]
    hooks = Hooks(lambda s: told.append("start"), lambda why, safe: told.append((why, "before", safe and safe.number)), lambda why, safe: told.append((why, "after", safe and safe.number)))
    sink = SignedSink(spark, path, list(old.tables.values()), hooks=hooks)
    sink.bind("pipe-1")
    assert sink.state().cursor.number == 2
    sink.write(rows_of("3a"), c("3a"), c("1")[0])
    sink.fork(c("2 3b"))
    assert told == ["start", ("recovery", "before", 2), ("recovery", "after", 2), ("fork", "before", 2), ("fork", "after", 2)]
    assert list(sink.manifest.read()["states"]) == ["pipe-1"]
    other = SignedSink(spark, path, list(old.tables.values()), state_id="mine")
    other.bind("pipe-1")
    assert other.state() == PipeState()


def test_removal_by_engine(spark, tmp_path):
    signed = T.StructType([*BLOCKS.fields, T.StructField("sign", T.IntegerType())])
    rows = frame(spark, "1 2 3").withColumn("sign", F.lit(1))
    make = lambda name, **how: SignedSink(spark, str(tmp_path / name), [Table("blocks", signed, **how)])
    for name, how, raw in (("a", {"engine": "collapsing"}, 4), ("b", {}, 2)):
        sink = make(name, **how)
        sink.write({"blocks": rows}, c("1 2 3"), c("1")[0])
        sink.remove("blocks", F.col("block_number") > 2)
        assert hashes(sink.rows("blocks")) == ["1", "2"] and sink.raw("blocks").count() == raw
        sink.cancel("blocks", rows.where("block_number = 2"))
        assert hashes(sink.rows("blocks")) == ["1"]
    for how, code in (({"engine": "distributed"}, "E2003"), ({"engine": "collapsing", "collapse": "other"}, "E2004")):
        with pytest.raises(LoomError, match=code):
            make(code, **how).remove("blocks", F.lit(True))


def test_rotation_gaps_and_foreign_encoders(spark, tmp_path):
    write = lambda sink, n: sink.write({"blocks": frame(spark, str(n))}, c(str(n)), c(str(n))[0])
    segments = lambda sink: sink.manifest.read().get("segments", {}).get("blocks", [])
    declared = [Table("blocks", BLOCKS)]
    by_rows = SegmentSink(spark, str(tmp_path / "rows"), declared, start=1, rotation=Rotation(None, rows=3))
    for k in range(1, 5):
        write(by_rows, k)
    assert segments(by_rows) == ["000000000001-000000000003"]
    now = [0.0]
    by_time = SegmentSink(spark, str(tmp_path / "time"), declared, start=1, rotation=Rotation(None, seconds=60), clock=lambda: now[0])
    write(by_time, 1)
    now[0] = 61.0
    write(by_time, 2)
    assert segments(by_time) == ["000000000001-000000000002"]
    by_bytes = SegmentSink(spark, str(tmp_path / "bytes"), declared, start=1, rotation=Rotation(None, bytes=1))
    write(by_bytes, 1)
    write(by_bytes, 2)
    assert segments(by_bytes) == ["000000000001-000000000002"]
    gaps = SegmentSink(spark, str(tmp_path / "gaps"), declared, ranges=[Range(5, 6), Range(20)])
    for k in (5, 6, 20):
        write(gaps, k)
    assert segments(gaps) == ["000000000005-000000000005", "000000000006-000000000006", "000000000020-000000000020"]
    with pytest.raises(LoomError, match="E2316"):
        gaps._check_range(7, 6)
    for k, encode in enumerate((lambda df, to: df.write.json(to), lambda df, to: df.select("hash").write.parquet(to))):
        with pytest.raises(LoomError, match="E2320"):
            write(SegmentSink(spark, str(tmp_path / f"foreign{k}"), declared, encode=encode), 1)


def test_values_are_checked(spark, tmp_path):
    strict = T.StructType([T.StructField("block_number", T.LongType(), False), T.StructField("day", T.DateType()), T.StructField("name", T.StringType(), False)])
    table = Table("t", strict)
    good = [(1, "2020-01-01", "x"), (2, None, "y")]
    make = lambda rows: spark.createDataFrame(rows, "block_number long, day string, name string").withColumn("day", F.col("day").cast("date"))
    assert table.checked(make(good), Range(1, 2)).count() == 2
    for rows, what in (([(3, None, "x")], "E2312"), ([(None, None, "x")], "E2312"), ([(1, "1969-12-31", "x")], "E2313"), ([(1, None, None)], "E2313")):
        with pytest.raises(Exception, match=what):
            table.checked(make(rows), Range(1, 2)).collect()


def test_declared_tables_are_checked(spark, tmp_path):
    number = T.StructField("block_number", T.LongType())
    deep = T.LongType()
    for _ in range(40):
        deep = T.ArrayType(deep)
    for fields, code in (([], "E2303"), ([T.StructField("x", T.LongType())], "E2304"), ([T.StructField("block_number", T.StringType())], "E2305"), ([number, T.StructField("x", T.CalendarIntervalType())], "E2307"), ([number, T.StructField("x", T.StructType([]))], "E2315"), ([number, T.StructField("x", deep)], "E2315")):
        with pytest.raises(LoomError, match=code):
            Table("t", T.StructType(fields))
    for declared, code in (([], "E2301"), ([Table("t", BLOCKS), Table("t", BLOCKS)], "E2302")):
        with pytest.raises(LoomError, match=code):
            SegmentSink(spark, str(tmp_path), declared)
    t = Table("t", BLOCKS)
    with pytest.raises(LoomError, match="E2207"):
        t.check(spark.range(1).toDF("block_number"))
    with pytest.raises(LoomError, match="E2208"):
        t.check(spark.createDataFrame([(1, 2)], "block_number long, hash long"))


def test_function_sink(spark):
    got = []
    sink = FunctionSink(spark, lambda rows, blocks, head, before: got.append((sorted(rows), [b.number for b in blocks], before.cursor)), lambda canonical: canonical[0])
    sink.write({"a": None}, c("1 2"), c("1")[0])
    sink.write({"a": None}, c("2"), None)
    assert got == [(["a"], [1, 2], None)] and sink.fork(c("1")).cursor == c("1")[0]
    for resolve, code in ((None, "E1001"), (lambda x: None, "E1003")):
        with pytest.raises(LoomError, match=code):
            FunctionSink(spark, print, resolve).fork(c("1"))


def block(text):
    logs = lambda b: [{"logIndex": 0, "transactionIndex": 0, "address": f"0x{b.hash[2:]}", "topics": ["0xt"], "data": "0x"}]
    return [{"header": {"number": b.number, "hash": b.hash, "timestamp": b.number * 1000}, "logs": logs(b)} for b in c(text)]


def record(folder, *rows):
    """A file for each response."""
    folder.mkdir(exist_ok=True)
    for r in rows:
        path = folder / f"{r['seq']:06d}.json"
        path.write_text(json.dumps(r) + "\n")
        os.utime(path, (r["seq"], r["seq"]))  # Spark takes files by time
    return str(folder)


def recorded(folder):
    return record(
        folder,
        {"seq": 1, "status": 200, "finalized_number": 1, "finalized_hash": "0x1", "bytes": 100, "latest_number": 9, "blocks": block("1 2 3a")},
        {"seq": 2, "status": 503},
        {"seq": 3, "status": 204, "finalized_number": 2, "finalized_hash": "0x2"},
        {"seq": 4, "status": 409, "previous_blocks": [{"number": b.number, "hash": b.hash} for b in c("2 3b")]},
        {"seq": 5, "status": 200, "finalized_number": 3, "finalized_hash": "0x3b", "bytes": 50, "blocks": block("3b 4")},
    )


def rows_of_headers(blocks):
    return {"blocks": blocks.select(F.col("header.number").alias("block_number"), F.col("header.hash").alias("hash"))}


def test_stream_end_to_end(spark, tmp_path):
    log = recorded(tmp_path / "log")
    sink = SegmentSink(spark, str(tmp_path / "out"), [Table("blocks", BLOCKS)])
    told = Progress("p", start=1)
    run_pipes({"one": lambda: start(responses(spark, log, "evm", files=2), "evm", sink, rows_of_headers, str(tmp_path / "checkpoint"), progress_of=told)})
    assert hashes(sink.rows("blocks")) == ["1", "2", "3b"]
    assert sink.state().cursor == Cursor(4, "0x4", 4000)
    assert (told.processed, told.latest, told.blocks, told.bytes, told.forks, told.requests) == (4, 9, 5, 150, 1, {200: 2, 503: 1, 204: 1, 409: 1})
    metrics = {(r.metric, r.label): r.value for r in told.rows(spark, 10.0).collect()}
    assert metrics["progress_ratio", None] == 3 / 8 and metrics["eta_seconds", None] == 10.0 and metrics["forks_total", None] == 1
    assert {r.metric: r.value for r in Progress("q").rows(spark, 1.0).collect()}["processed_block"] == -1
    record(tmp_path / "log", {"seq": 6, "status": 200, "finalized_number": 5, "finalized_hash": "0x5", "blocks": block("5")})
    run_pipes({"one": lambda: start(responses(spark, log, "evm", files=1), "evm", sink, rows_of_headers, str(tmp_path / "checkpoint"))})
    assert hashes(sink.rows("blocks")) == ["1", "2", "3b", "4", "5"]


def test_final_blocks_only_and_one_block_a_batch(spark, tmp_path):
    log = record(tmp_path / "log", {"seq": 1, "status": 200, "finalized_number": 2, "finalized_hash": "0x2", "blocks": block("1 2 3 4")})
    seen = []
    for k, options in enumerate(({"finalized_only": True}, {"per_block": True})):
        sink = FunctionSink(spark, lambda rows, blocks, head, before: seen.append([b.number for b in blocks]))
        start(responses(spark, log, "evm"), "evm", sink, lambda b: {}, str(tmp_path / f"c{k}"), **options).awaitTermination()
    assert seen == [[1, 2], [1, 2], [3], [4]]


def test_unknown_statuses_are_refused(spark, tmp_path):
    log = record(tmp_path / "log", {"seq": 1, "status": 418})
    sink = FunctionSink(spark, lambda *x: None)
    with pytest.raises(Exception, match="status 418"):
        start(responses(spark, log, "evm"), "evm", sink, lambda b: {}, str(tmp_path / "c")).awaitTermination()


def test_missing_responses_are_refused(spark, tmp_path):
    log = record(tmp_path / "log", {"seq": 2, "status": 200, "blocks": block("1")})
    with pytest.raises(Exception, match="response 2 came after 0"):
        start(responses(spark, log, "evm"), "evm", FunctionSink(spark, lambda *x: None), lambda b: {}, str(tmp_path / "c")).awaitTermination()


def test_pipe_of_transformers(spark, tmp_path):
    log, told = recorded(tmp_path / "log"), []
    schema = T.StructType([T.StructField("block_number", T.LongType()), T.StructField("address", T.StringType())])
    only = Transformer(lambda rows: {"found": rows["logs"].select("block_number", "address")}, "pick", lambda q: q.add_request("logs", Range(2)), lambda: told.append("start"), lambda cursor: told.append(cursor.number), lambda: told.append("stop"))
    child = Transformer(lambda rows: {"found": rows["found"].where("address <> '0x2'")}, stop=lambda: told.append("child stops"))
    pipe = Pipe("p", Query("evm")).pipe(Transformer(id="pick", children=(only, child))).pipe(lambda rows: rows).pipe(lambda rows: rows)
    assert [s.id for s in pipe.steps] == ["pick", "step", "step-2"]
    sink = SegmentSink(spark, str(tmp_path / "out"), [Table("found", schema)])
    pipe.run_to(spark, log, sink, str(tmp_path / "checkpoint"))
    assert sorted(r.address for r in sink.rows("found").collect()) == ["0x3b"]
    assert told == ["start", 2, "stop", "child stops"] and list(sink.manifest.read()["states"]) == ["p"]
    with pytest.raises(LoomError, match="E0001"):
        Pipe("", Query("evm")).run_to(spark, log, sink, str(tmp_path / "c2"))
    broken = Pipe("b", Query("evm")).pipe(only).pipe(lambda rows: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision"):
        broken.run_to(spark, log, SegmentSink(spark, str(tmp_path / "o2"), [Table("found", schema)]), str(tmp_path / "c3"))
    assert told[-1] == "stop"


def test_factory_children_follow_the_chain(spark, tmp_path):
    from ledgerloom.functions import abi
    from ledgerloom.streaming.factory import ChildStore, Factory

    made = abi.event("Made(address indexed token, address child, uint24 fee)")

    def log(number, i, child, emitter="0x" + "f" * 40, fee=500):
        topics, data = abi.encode_event(made, {"token": "0x" + "a" * 40, "child": child, "fee": fee})
        return (number, 0, i, emitter, topics, data)

    frame_of = lambda *rows: spark.createDataFrame(list(rows), "block_number long, transaction_index long, log_index long, address string, topics array<string>, data string")
    one, two, three = ("0x" + x * 40 for x in "123")
    store = ChildStore(spark, str(tmp_path / "children"))
    factory = Factory(store, ["0x" + "F" * 40], made, "child", {"fee": [500]})
    factory.remember(frame_of(log(1, 0, one), log(1, 1, two, fee=3000), log(2, 0, one, fee=3000)))
    assert sorted((r.child_address, r.block_number) for r in store.all().collect()) == [(one, 1), (two, 1)]
    batch = frame_of(log(5, 1, three), (4, 0, 0, three, ["0xt"], "0x"), (5, 0, 2, one.upper().replace("X", "x"), ["0xt"], "0x"), (5, 0, 3, two, ["0xt"], "0x"))
    assert sorted((r.block_number, r.log_index) for r in factory.of_children(batch).collect()) == [(4, 0), (5, 2)]
    factory.remember(batch)
    factory.rollback(4)
    assert sorted(r.child_address for r in store.lookup().collect()) == [one, two]
    assert [r.child_address for r in store.lookup(params={"FEE".lower(): ["3000"]}).collect()] == [two]
    foreign = Factory(store, ["0x" + "e" * 40], made, "child")
    assert foreign.of_children(batch).count() == 0
    blocks = [{"header": {"number": n, "hash": f"0x{n}", "timestamp": n}, "logs": [{"logIndex": 0, "transactionIndex": 0, "address": "0x" + "f" * 40, "topics": log(n, 0, three)[4], "data": log(n, 0, three)[5]}]} for n in (7, 9)]
    path = tmp_path / "b.json"
    path.write_text("".join(json.dumps(b) + "\n" for b in blocks))
    from ledgerloom.sources import schemas

    assert factory.index_ahead(schemas.read_blocks(spark, str(path), "evm"), 8) == 3
    assert store.all().where(F.col("child_address") == three).first().block_number == 7


def test_retries():
    answers, waits = iter([(503, None), (429, None), (200, "x")]), []
    assert with_retries(lambda: next(answers), waits.append) == (200, "x")
    assert waits == [0.01, 0.1]
    assert with_retries(lambda: (500, None), waits.append)[0] == 500


def test_delete_order():
    assert delete_order({"a": ["b"], "b": ["c"], "c": []}) == ["a", "b", "c"]
    with pytest.raises(LoomError, match="E2106"):
        delete_order({"a": ["b"], "b": ["a"]})


def test_sql_files_run_in_order(spark, tmp_path):
    (tmp_path / "2.sql").write_text("CREATE OR REPLACE TEMP VIEW two AS SELECT x + 1 AS x FROM one")
    (tmp_path / "1.sql").write_text("CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS x;\nSELECT 'a;b' FROM one;\n")
    run_sql_files(spark, str(tmp_path))
    assert spark.table("two").first().x == 2


def test_recorded_responses_hold_few_blocks(spark, monkeypatch):
    """No response, which one task reads, holds a share of all blocks; many responses before and after a fork give the same rows."""
    import duckdb

    from ledgerloom import chain_queries
    from ledgerloom.queries import SQL

    sf, largest = "/root/testdata/sf0.001", []
    read = chain_queries.responses

    def looked(spark, path, *rest):
        frame = spark.read.json(path)
        largest.append(frame.agg(F.max(F.size("blocks"))).first()[0])
        return read(spark, path, *rest)

    monkeypatch.setattr(chain_queries, "responses", looked)
    monkeypatch.setattr(chain_queries, "SPAN", 7, raising=False)
    got = sorted(tuple(r) for r in chain_queries.recorded_stream(spark, sf).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert got == sorted(db.execute(SQL["recorded_stream"]).fetchall())
    assert largest == [7]
