"""Rows held back in the state of a streaming query, against a loop over all rows."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.chain_queries import ROCKS
from ledgerloom.streaming.holdback import _Waiting, held_stream, still_held

ROW = T.StructType([T.StructField("block_number", T.LongType()), T.StructField("s", T.StringType()), T.StructField("t", T.TimestampType()), T.StructField("d", T.DecimalType(38, 18))])
DECIMALS = ["12345678901234567890.123456789012345678", "0.000000000000000001", None]


def made(seed):
    """Responses: rows of blocks around the head, floors that may be missing or fall, forks of which some keep the rows."""
    rng, out, head = random.Random(seed), [], 0
    for seq in range(1, 9):
        if seq % 3 == 0:
            out.append({"seq": seq, "fork": True, "safe": None if seq == 6 else head - rng.randrange(3, 9)})
            continue
        rows = [{"block_number": rng.choice([head + rng.randrange(12), head + rng.randrange(12), None]), "s": rng.choice([None, "", 'a"\né', "x"]), "t": "2024-05-01T10:00:00.123456Z", "d": rng.choice(DECIMALS)} for _ in range(rng.choice([0, 30, 30]))]
        rows += rows[:3]  # repeated rows
        head += 8
        out.append({"seq": seq, "rows": rows or None, "finalized": None if seq in (1, 5) else head - rng.randrange(5, 30)})
    return out


def expected(responses):
    held, released, floor = [], [], None
    for r in responses:
        if r.get("fork"):
            held = held if r["safe"] is None else [x for x in held if x["block_number"] <= r["safe"]]
            continue
        held += [x for x in r["rows"] or [] if x["block_number"] is not None]
        floor = max((x for x in (floor, r["finalized"]) if x is not None), default=None)
        final = [x for x in held if floor is None or x["block_number"] <= floor]
        held = [x for x in held if not (floor is None or x["block_number"] <= floor)]
        released += [(r["seq"], x) for x in final]
    return released, held


def plain(rows):
    return sorted(((r.block_number, r.s, r.t.microsecond, None if r.d is None else format(r.d, "f")) for r in rows), key=repr)


def given(rows):
    return sorted(((x["block_number"], x["s"], 123456, x["d"]) for x in rows), key=repr)


@pytest.mark.parametrize("restarts", [True, False])
def test_held_rows_with_forks_and_restarts(spark, tmp_path, restarts):
    """The query is stopped and started again after each response, or takes all at once: released and held rows are the same."""
    pytest.importorskip("google.protobuf")
    responses = made(4)
    where = {name: str(tmp_path / name) for name in ("in", "out", "checkpoint")}
    (tmp_path / "in").mkdir()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        for k, response in enumerate(responses):
            (tmp_path / "in" / f"{k}.json").write_text(json.dumps(response) + "\n")
            if not restarts and k < len(responses) - 1:
                continue
            stream = spark.readStream.schema(f"seq bigint, rows array<{ROW.simpleString()}>, finalized bigint, fork boolean, safe bigint").json(where["in"])
            rows = held_stream(stream, F.col("rows"), ROW, F.col("finalized"), F.coalesce("fork", F.lit(False)), F.col("safe"))
            rows.writeStream.format("parquet").option("path", where["out"]).option("checkpointLocation", where["checkpoint"]).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    released, held = expected(responses)
    got = spark.read.parquet(where["out"]).collect()
    for seq in {r.released for r in got} | {s for s, _ in released}:
        assert plain([r for r in got if r.released == seq]) == given([x for s, x in released if s == seq])
    assert plain(still_held(spark, where["checkpoint"], ROW).collect()) == given(held) and len(held) > 3 and len(got) > 40


def test_final_rows_leave_in_large_parts():
    """Rows that are final with what came beside them touch no state and leave part by part, not block by block."""
    import pandas as pd

    class Values(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)

    class Numbers(dict):
        getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__  # noqa: N815

    state = _Waiting()
    state.floor, state.held = Values(), Numbers()
    rows = pd.DataFrame({"seq": 1, "kind": "row", "number": range(5000), "payload": "{}"})
    told = pd.DataFrame({"seq": [1, 2, 3], "kind": ["floor", "fork", "floor"], "number": [4000, 4900, 4500], "payload": None})
    parts = list(state.handleInputRows((0,), iter([rows.astype({"number": "float"}), told]), None))
    got = pd.concat(parts)
    assert len(parts) == 1 and got.groupby("released").size().to_dict() == {1: 4001, 3: 500}
    assert [k[0] for k in sorted(state.held)] == list(range(4501, 4901)) and state.floor["v"] == (4500,)
