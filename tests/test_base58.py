"""Base-58 expressions against plain Python, and what of them reaches files."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import base58
from ledgerloom.operators import filters

PREFIXES = [b"\x01", b"\xff", b"\0", b"\x02\x01", b"\0\x07", b"\0\0", b"\x66\x06\x3d\x12", b"\x66\x06\x3d\x12\x01\xda\xeb\xea", b"\0\0\0\0\0\0\0\x02", b"\xff" * 8]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    out = [b"", b"\0", b"\0" * 9, b"\x01", b"\xff" * 40]
    for n in [*range(1, 60), 100, 370, 375, 380, 900, 1232]:
        out += [rng.randbytes(n) for _ in range(2)] + [(p + rng.randbytes(n))[: max(n, 1)] for p in PREFIXES]
    for p in PREFIXES:  # the ends of each interval, and their neighbours
        for k in range(0, 50):
            low = int.from_bytes(p, "big") << 8 * k
            for number in (low - 1, low, low + (1 << 8 * k) - 1, low + (1 << 8 * k)):
                if 0 <= number < 256 ** (len(p) + k):
                    out.append(number.to_bytes(len(p) + k, "big"))
    return out


def test_texts_and_data(spark, data):
    rows = [(base58.encode(d), d.hex()) for d in data]
    df = spark.createDataFrame([*rows, (None, None), ("0", None), ("3DXy58UDhJu\n", None), ("Il", None)], "t string, h string")
    for r in df.select("t", "h", base58.to_hex(F.col("t")).alias("to"), base58.from_hex(F.col("h")).alias("from")).collect():
        assert (r.to, r["from"]) == (("0x" + r.h, r.t) if r.h is not None else (None, None))
    assert all(base58.decode(t).hex() == h for t, h in rows)


def test_prefixes_equal_decoded_data(spark, data):
    """Every prefix on every text: ends of intervals, texts beyond the table, leading zeros, null and what isn't base 58."""
    df = spark.createDataFrame([(base58.encode(d), d.hex()) for d in data] + [(None, None), ("0OIl", None)], "t string, h string")
    got = df.select("h", *[base58.starts_with(F.col("t"), p).alias(p.hex()) for p in PREFIXES]).collect()
    for r in got:
        assert [r[p.hex()] for p in PREFIXES] == [None if r.h is None else r.h.startswith(p.hex()) for p in PREFIXES], r.h
    assert all(sum(bool(r[p.hex()]) for r in got) > 20 for p in PREFIXES)


def test_values_are_those_of_the_first_bytes(spark, data):
    """d4 asks for four bytes; shorter values mean data that end there; other texts mean nothing. The same as by decoded data."""
    rows = [(base58.encode(d), "0x" + d.hex()) for d in data if len(d) < 30]
    plain = spark.createDataFrame(rows, "data string, h string")
    decoded = plain.withColumn("data_hex", F.col("h"))
    for width, values in ((4, ["0x66063d12", "0x01", "0x", "0x0000000002", "0xFF", "66063d12", "0x6"]), (1, ["0xff"]), (8, ["0xffffffffffffffff", "0x0000000000000002", "0x00"]), (2, [])):
        found = [sorted(r.h for r in df.where(filters.request_predicate({f"d{width}": values}, df.columns)).collect()) for df in (plain, decoded)]
        assert found[0] == found[1] and bool(found[0]) == bool(values)


def test_a_prefix_reaches_the_statistics_of_files(spark, tmp_path):
    rng = random.Random(6)
    wanted = bytes.fromhex("66063d1201daebea")
    rows = [(base58.encode((wanted if k % 50 == 0 else b"") + rng.randbytes(rng.randrange(8, 40))),) for k in range(4000)]
    longest = max(len(r[0]) for r in rows)
    spark.createDataFrame(rows, "data string").repartitionByRange(16, "data").sortWithinPartitions("data").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    exact = table.where(base58.starts_with(F.col("data"), wanted))
    pruned = table.where(base58.pruning(F.col("data"), [wanted], longest) & base58.starts_with(F.col("data"), wanted))
    assert sorted(pruned.collect()) == sorted(exact.collect()) and exact.count() >= 80
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(data," in plan.partition("PushedFilters")[2] and "Python" not in plan
    cover = base58.ranges(wanted, longest)
    assert all(a <= b for a, b in cover) and all(x[1] < y[0] for x, y in zip(cover, cover[1:], strict=False))
    assert table.where(base58.pruning(F.col("data"), [wanted], longest)).count() < 200
    assert table.where(base58.pruning(F.col("data"), [], longest)).count() == 0
