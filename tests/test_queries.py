"""Every query with a SQL twin gives the twin's rows at sf0.001."""

import datetime
import glob
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import queries
from ledgerloom.operators import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def left(spark):
    """What lies in the folder that the cluster shares."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:").replace("//", "/", 1)
    return set(os.listdir(shared)) if os.path.isdir(shared) else set()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_twin(spark, duck, name):
    before = left(spark)
    df = queries.QUERIES[name](spark, SF)
    assert {x.partition("-")[0] for x in left(spark) - before} <= {"result"}  # what a query writes on its way is gone
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_segments_by_key_without_nested_loops(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        low = rng.randrange(-50, 5000)
        rows.append((rng.randrange(4), i, low, low + rng.choice([0, 3, 40, 900])))
    requests = spark.createDataFrame(rows, "k long, id long, low long, high long")
    for keys in ([], ["k"]):
        expected = []
        for group in {tuple(r[:1]) if keys else () for r in rows}:
            held = [r for r in rows if not keys or r[:1] == group]
            cuts = sorted({r[2] for r in held} | {r[3] + 1 for r in held})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if ids := sorted(r[1] for r in held if r[2] <= a and r[3] >= b - 1):
                    expected.append((*group, a, b - 1, ids))
        got = tables.segments(requests, keys=keys)
        assert sorted(map(tuple, got.collect())) == sorted(expected)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert tables.segments(requests.limit(0)).count() == 0


def test_stretches_join_up(spark):
    """Rows before, numbers and rates are those of a plain window over each key, however the positions are cut."""
    rng = random.Random(2)
    rows = [(rng.randrange(3), at, at * 2 + rng.randrange(5), rng.randrange(100)) for at in sorted(rng.sample(range(5000), 700))]
    df = spark.createDataFrame(rows, "k long, ts long, block_number long, bytes long")
    by = {k: [r for r in rows if r[0] == k] for k in range(3)}
    place = {r: i for k in by for i, r in enumerate(by[k])}
    got = tables.numbered(tables.previous(df, ["k"], "ts", "bytes", "before", span=40), ["k"], "ts", "n", span=40).collect()
    assert len(got) == len(rows)
    for r in got:
        i = place[tuple(r)[:4]]
        assert r.n == i and r.before == (by[r.k][i - 1][3] if i else None)
    for r in tables.throughput(df, ["k"], rows=10, stretch=23).collect():
        i = place[tuple(r)[:4]]
        last = by[r.k][max(0, i - 9) : i + 1]
        seconds = r.ts - last[0][1]
        assert abs(r.blocks_per_s - ((r.block_number - last[0][2]) / seconds if seconds else 0)) < 1e-9
        assert abs(r.bytes_per_s - (sum(x[3] for x in last) / seconds if seconds else 0)) < 1e-9


@pytest.mark.parametrize("name", ["instruction_decode", "program_events", "instruction_prefixes", "dynamic_events", "calldata_decode", "trace_requests", "call_stacks"])
def test_no_python_in_the_plan(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_continuity_equals_a_loop(spark):
    """Null keys, hashes and parents, repeated rows, numbers in any order, a block that a third of all rows repeat, stretches of numbers."""
    rng = random.Random(8)
    rows = []
    for chain in (None, "", "a"):
        for n in rng.sample([*range(60), *range(99_990, 100_010), 250_000], 70):
            rows += [(chain, n, f"h{n}-{rng.randrange(2)}", rng.choice([None, f"h{n - 1}-{rng.randrange(2)}"])) for _ in range(rng.choice([1, 1, 2]))]
    rows += [("a", 5, "h5-0", "h4-1")] * 120 + [("a", None, "x", None), ("a", 7, None, None)]
    expected = []
    for chain in (None, "", "a"):
        own = [r for r in rows if r[0] == chain and r[1] is not None]
        numbers = sorted({r[1] for r in own})
        expected += [(chain, "gap", a + 1, b - 1, b - a - 1) for a, b in zip(numbers, numbers[1:], strict=False) if b > a + 1]
        for n in numbers:
            here, before = [r for r in own if r[1] == n], [r[2] for r in own if r[1] == n - 1]
            lost = sum(r[3] is not None and r[3] not in before for r in here)
            expected += [(chain, "repeat", n, n, len(here))] * (len(here) > 1) + [(chain, "link", n, n, lost)] * (bool(before) and lost > 0)
    df = spark.createDataFrame(rows, "chain string, number long, hash string, parent string")
    got = tables.continuity(df, ["chain"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr) and len({r[1] for r in expected}) == 3
    one = tables.continuity(df.where("chain = ''"))
    assert sorted(map(tuple, one.collect())) == sorted(r[1:] for r in expected if r[0] == "")
    assert tables.continuity(df.limit(0)).count() == 0
