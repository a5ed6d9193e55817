"""Joins of what lies within transactions, against loops over all pairs, and at sizes that all pairs don't allow."""

import random
import time

from pyspark.sql import functions as F

from ledgerloom.operators import joins


def below(outer, inner):
    return outer is not None and inner is not None and len(inner) > len(outer) and inner[: len(outer)] == outer


def test_descendants_and_their_counts_equal_all_pairs(spark):
    """Null keys and paths, empty paths, repeated items, large positions, extra columns with names that are used inside."""
    rng = random.Random(3)
    part = lambda: rng.choice([0, 1, 2, 15, 16, 255, 2**40])
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.choice([None, *[[part() for _ in range(n)] for n in (0, 1, 1, 2, 2, 3, 4)]]), "k", 1) for i in range(260)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "tx long, i long, path array<long>, _key string, _last int")
    pairs = [(a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and below(a[2], b[2])]
    assert sorted((r.i, r.inner_i) for r in joins.descendants(df, "path", ["tx"]).collect()) == sorted(pairs) and len(pairs) > 500
    got = joins.descendant_counts(df, "path", ["tx"])
    assert got.columns == [*df.columns, "n_inner"]
    each = [(r[1], sum(r[0] is not None and r[0] == b[0] and below(r[2], b[2]) for b in rows)) for r in rows]
    assert sorted((r.i, r.n_inner) for r in got.collect()) == sorted(each)
    assert joins.descendant_counts(df.limit(0), "path", ["tx"]).count() == 0


def test_a_transaction_of_a_hundred_thousand_items(spark):
    """A tree of 100,000 items in one transaction: counts, and one exchange in the plan."""
    items = spark.range(100_000).selectExpr("id div 1000000 as tx", "id as i", "if(id = 0, cast(array() as array<bigint>), if(id <= 300, array(id), array(id % 300 + 1, id))) as path")
    began = time.time()
    got = joins.descendant_counts(items, "path", ["tx"])
    found = {r.i: r.n_inner for r in got.where("i <= 300").collect()}
    assert time.time() - began < 60
    assert found[0] == 99_999 and sum(v for k, v in found.items() if k) == 100_000 - 301
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_children_of_a_large_factory(spark, tmp_path):
    """Beyond the broadcast: the same rows; one address in 30 % of the logs doesn't gather in a task; logs of no child aren't shuffled."""
    children = spark.range(3000).selectExpr("concat('c', id) as child_address", "id as created", "if(id % 2 = 0, 'f', null) as factory")
    rows = spark.range(0, 200_000, 1, 8).selectExpr("id as i", "case when id % 10 < 3 then 'c7' when id % 10 < 6 then concat('c', id % 2999) when id % 10 = 9 then null else concat('other', id) end as address")
    rows.write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = logs.where(joins.address_filter(children, "child_address", 3000)(logs.address))
        foreign = near.where("address like 'other%'").count()
        assert foreign < 60_000 * 0.03 and near.where("address like 'c%'").count() == logs.where("address like 'c%'").count()
        split = joins.join_children(logs, children, broadcast_up_to=10)
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1 and "Cartesian" not in plan
        by_hash = [r["count"] for r in split.where("address <> 'c7'").groupBy(F.spark_partition_id()).count().collect()]
        by_scan = [r["count"] for r in split.where("address = 'c7'").groupBy(F.spark_partition_id()).count().collect()]
        for sizes in (by_hash, by_scan):
            assert len(sizes) >= 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
        plain = joins.join_children(logs, children)
        assert split.columns == plain.columns and split.exceptAll(plain).count() == plain.exceptAll(split).count() == 0 and plain.count() > 100_000
        even = joins.join_children(logs.where("address like 'c%' and address <> 'c7'"), children, broadcast_up_to=10)
        assert even.count() == plain.where("address <> 'c7'").count()
        for some, made in ((logs.limit(0), children), (logs, children.limit(0)), (logs.where("address is null"), children)):
            assert joins.join_children(some, made, broadcast_up_to=-1).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_linked_ancestor_equals_the_join(spark):
    """Chains with gaps, forks anywhere and nowhere, by few numbers a round; the other chain may be longer or shorter."""
    rng = random.Random(9)
    kind = "number long, hash string"
    for case in range(14):
        top = rng.choice([40, 400])
        mine = sorted(rng.sample(range(10**6), top)) if case % 2 else [*range(top), *range(10**6, 10**6 + top)]
        fork = [rng.choice(mine), mine[0], -1, mine[-1] + 1, mine[-3]][case % 5]
        chain = spark.createDataFrame([(n, f"{n}{'a' if n < fork else 'b'}") for n in mine], kind)
        other = spark.createDataFrame([(n, f"{n}a") for n in mine if rng.random() < 0.9 or case < 8] + [(2 * 10**6, "x")], kind)
        got = [tuple(r) for r in joins.linked_ancestor(chain, other, fan=4, stretch=5).collect()]
        if case < 8:
            assert got == [tuple(r) for r in joins.fork_ancestor(chain, other).collect()]
            assert got == [(n, f"{n}a") for n in mine if n < fork][-1:]
        else:  # the other chain lacks blocks: still one that both have
            assert all((n, h) in {tuple(r) for r in other.collect()} and n < fork for n, h in got)
    assert joins.linked_ancestor(chain.limit(0), other).count() == joins.linked_ancestor(chain, other.limit(0)).count() == 0


def test_the_fork_of_two_long_chains(spark, tmp_path):
    """Two million blocks each: the driver looks at some hundred hashes, the last join at a stretch of them."""
    blocks = lambda name, fork: spark.range(2_000_000).selectExpr("id as number", f"concat(id, if(id < {fork}, 'a', '{name}')) as hash").write.parquet(str(tmp_path / name))
    blocks("mine", 1_234_567)
    blocks("other", 1_234_567)
    got = joins.linked_ancestor(*[spark.read.parquet(str(tmp_path / n)) for n in ("mine", "other")], stretch=1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1_234_566, "1234566a")] and plan.count("LessThanOrEqual(number,") >= 2
