"""A table by block ranges: rows against a list, folders that are touched, and the partition filters of its scans."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sinks.layout import BlockLayout

SCHEMA = T.StructType([T.StructField("block_number", T.LongType()), T.StructField("v", T.StringType())])


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_rows_after_deletions_equal_a_list(spark, tmp_path):
    """Ends within and at the edges of folders, folders that become empty, ranges beyond all blocks, a step that is run again."""
    rng = random.Random(7)
    table = BlockLayout(spark, str(tmp_path / "t"), SCHEMA, 10)
    assert table.rows().count() == 0
    table.delete(0, 5)
    rows = [(rng.randrange(95), rng.choice([None, "a", "b"])) for _ in range(300)] + [(33, "x")] * 40
    table.append(spark.createDataFrame(rows[:200], SCHEMA))
    table.append(spark.createDataFrame(rows[200:], SCHEMA).select("v", "block_number", F.lit(1).alias("more")))
    table.append(spark.createDataFrame([], SCHEMA))
    check = lambda: sorted(map(tuple, table.rows().collect()), key=repr) == sorted(rows, key=repr)
    assert check()
    for low, high in ((12, 14), (20, 29), (38, 52), (38, 52), (9, 10), (200, 300), (60, 60), (7, 3), (71, None), (60, None)):
        before = files(tmp_path)
        table.delete(low, high)
        rows = [r for r in rows if not (low <= r[0] and (high is None or r[0] <= high))]
        assert check(), (low, high)
        top = low if high is None else high
        touched = {int(f.split("block_range=")[1].split("/")[0]) for f in before ^ files(tmp_path)}
        assert all(low // 10 <= k and (high is None or k <= top // 10) for k in touched)
    assert sorted(map(tuple, table.rows(11, 33).collect()), key=repr) == sorted([r for r in rows if 11 <= r[0] <= 33], key=repr)
    many = len(files(tmp_path))
    table.compact()
    assert check() and len(files(tmp_path)) <= many
    table.delete(0, None)
    assert table.rows().count() == 0


def test_scans_take_the_folders_of_a_range(spark, tmp_path):
    table = BlockLayout(spark, str(tmp_path / "t"), SCHEMA, 100)
    table.append(spark.range(1000).select(F.col("id").alias("block_number"), F.lit("v").alias("v")))
    found = table.rows(250, 420)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert ">= 2" in filters and "<= 4" in filters and "GreaterThanOrEqual(block_number,250)" in plan
    assert found.count() == 171 and len(set(found.inputFiles())) == len(files(tmp_path))  # all are known, three folders are read
    read = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("block_range=")[1].split("/")[0] for r in read} == {"2", "3", "4"}


def test_what_is_refused(spark, tmp_path):
    table = BlockLayout(spark, str(tmp_path / "t"), SCHEMA, 10)
    for bad in (None, -1):
        with pytest.raises(Exception, match="block number"):
            table.append(spark.createDataFrame([(bad, "x")], SCHEMA))
    assert table.rows().count() == 0
    with pytest.raises(ValueError, match="isn't positive"):
        BlockLayout(spark, str(tmp_path / "t"), SCHEMA, 0)
