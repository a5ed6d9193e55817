import json
import random
import re

import pytest

from ledgerloom.plans.query import RELATIONS, Query
from ledgerloom.plans.ranges import Range
from ledgerloom.sources import schemas


def write(path, blocks):
    path.write_text("".join(json.dumps(b) + "\n" for b in blocks))
    return str(path)


def evm(number, logs=(), txs=(), traces=None):
    out = {"header": {"number": number, "hash": f"0x{number}", "timestamp": number}, "logs": list(logs), "transactions": list(txs)}
    return out | ({"traces": traces} if traces is not None else {})


def log(i, tx, address, topic="0xt"):
    return {"logIndex": i, "transactionIndex": tx, "address": address, "topics": [topic], "data": "0x"}


def tx(i, sender="0xs"):
    return {"transactionIndex": i, "from": sender, "hash": f"0xh{i}"}


def trace(t, *path):
    return {"type": "call", "transactionIndex": t, "traceAddress": list(path), "action": {"to": "0x" + "".join(map(str, path))}}


def test_requests_inclusions_and_all_blocks(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", [evm(1, [log(0, 0, "0xa"), log(1, 0, "0xb"), log(2, 1, "0xb")], [tx(0), tx(1)]), evm(2), evm(3, [log(0, 0, "0xa")], [tx(0)]), evm(4)])
    blocks = schemas.read_blocks(spark, path, "evm")
    q = Query("evm").add_request("logs", Range(0, 2), {"transaction": True, "transactionLogs": True}, address=["0xa"]).include_all_blocks(Range(4))
    out = q.run(blocks)
    assert sorted((r.block_number, r.logIndex) for r in out["logs"].collect()) == [(1, 0), (1, 1)]
    assert [(r.block_number, r.transactionIndex) for r in out["transactions"].collect()] == [(1, 0)]
    assert sorted(r.number for r in out["blocks"].collect()) == [1, 4]
    assert q.add_request("logs", address=[]).run(blocks)["logs"].count() == 2
    assert Query("evm").add_request("logs", topic0=["0xt"]).run(blocks, Range(2))["logs"].count() == 1


def test_parents_and_subtraces(spark, tmp_path):
    traces = [trace(0), trace(0, 2), trace(0, 2, 0), trace(0, 2, 0, 1), trace(0, 3), trace(1, 2)]
    blocks = schemas.read_blocks(spark, write(tmp_path / "b.jsonl", [evm(1, traces=traces)]), "evm")
    found = lambda flag: sorted(tuple(r.traceAddress) for r in Query("evm").add_request("traces", include={flag: True}, callTo=["0x20"]).run(blocks)["traces"].collect())
    assert found("subtraces") == [(2, 0), (2, 0, 1)]
    assert found("parents") == [(), (2,), (2, 0)]


def test_selection_prunes_the_schema(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", [evm(1, [log(0, 0, "0xa")])])
    blocks = schemas.read_blocks(spark, path, "evm", {"logs": {"address": True, "logIndex": True}})
    assert blocks.schema["logs"].dataType.elementType.names == ["logIndex", "address"]
    assert "traces" not in blocks.columns
    stored = str(tmp_path / "stored")
    schemas.read_blocks(spark, path, "evm").drop("block_time").write.parquet(stored)
    pruned = schemas.read_stored(spark, stored, "evm", {"logs": {"address": True}})
    assert [r.address for r in schemas.items(pruned, "logs").collect()] == ["0xa"]


def test_merge_hash_and_segments():
    a = Query("evm").add_request("logs", Range(0, 100), address=["0xa"]).add_fields({"log": {"data": True}})
    b = Query("evm").add_request("logs", Range(50, 150), address=["0xb"]).add_fields({"log": {"topics": True}})
    both = a.merge(b)
    assert both.fields == {"log": {"data": True, "topics": True}}
    assert [r.fields["address"] for r in both.requests] == [["0xb"], ["0xa"]]
    assert [(r.low, r.high, len(x)) for r, x in both.segments(Range(10, 120))] == [(10, 49, 1), (50, 100, 2), (101, 120, 1)]
    assert a.hash() == Query("evm").add_request("logs", Range(7), address=["0xa"]).add_fields({"log": {"data": True}}).hash() != b.hash()
    assert Query("evm").segments(Range(5)) == [(Range(5), [])]


def test_every_schema_parses(spark):
    assert {n: len(schemas.schema(n)) for n in schemas.DDL} == {"evm": 5, "solana": 7, "bitcoin": 4, "tron": 4, "hyperliquidFills": 2, "substrate": 4}


def header(n=1):
    return {"number": n, "hash": f"0x{n}", "timestamp": n}


def places(df, *columns):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58(data):
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = B58[d] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def test_evm_requests(spark, tmp_path):
    action = {"from": "0xf", "to": "0xt", "sighash": "0x12345678", "author": "0xm", "refundAddress": "0xr"}
    traces = [{"type": t, "transactionIndex": k, "traceAddress": [k], "action": action} for k, t in enumerate(("create", "call", "suicide", "reward"))]
    diffs = [{"transactionIndex": k, "address": "0xa", "key": f"k{k}", "kind": "+*-="[k]} for k in range(4)]
    txs = [{"transactionIndex": k, "from": f"0xf{k}", "to": "0xt", "sighash": f"0x{k}", "type": k % 3, "hash": f"0xh{k}"} for k in range(4)]
    logs = [{"logIndex": k, "transactionIndex": k % 2, "address": "0xa", "topics": [f"t{j}{k}" for j in range(4)], "data": "0x"} for k in range(4)]
    one = {"header": header(), "transactions": txs, "logs": logs, "traces": traces, "stateDiffs": diffs}
    blocks = schemas.read_blocks(spark, write(tmp_path / "b", [one]), "evm")
    run = lambda kind, /, include=None, **fields: Query("evm").add_request(kind, include=include, **fields).run(blocks)
    for i in range(4):
        assert places(run("logs", **{f"topic{i}": [f"t{i}2"]})["logs"], "logIndex") == [(2,)]
    for field, value, kind in (("createFrom", "0xf", "create"), ("callTo", "0xt", "call"), ("callFrom", "0xf", "call"), ("callSighash", "0x12345678", "call"), ("suicideRefundAddress", "0xr", "suicide"), ("rewardAuthor", "0xm", "reward")):
        assert places(run("traces", **{field: [value]})["traces"], "type") == [(kind,)]
    assert places(run("traces", type=["call", "reward"])["traces"], "type") == [("call",), ("reward",)]
    for field, value in (("from", "0xf1"), ("sighash", "0x1"), ("type", 1)):
        assert places(run("transactions", **{field: [value]})["transactions"], "transactionIndex") == [(1,)]
    assert places(run("stateDiffs", kind=["-"], key=["k2"], address=["0xa"])["stateDiffs"], "key") == [("k2",)]
    included = run("logs", {"transaction": True, "transactionTraces": True, "transactionStateDiffs": True, "transactionLogs": True}, topic0=["t01"])
    assert [places(included[n], "transactionIndex") for n in ("transactions", "traces", "stateDiffs")] == [[(1,)]] * 3 and places(included["logs"], "logIndex") == [(1,), (3,)]
    of_tx = run("transactions", {"logs": True, "traces": True, "stateDiffs": True}, sighash=["0x0"])
    assert [of_tx[n].count() for n in ("logs", "traces", "stateDiffs")] == [2, 1, 1]


def test_solana_requests(spark, tmp_path):
    data = [base58(bytes([1, 2, 3, 4, 5, 6, 7, k])) for k in range(3)]
    instructions = [{"transactionIndex": k, "instructionAddress": a, "programId": f"P{k}", "accounts": [f"acc{j}{k}" for j in range(10)], "data": data[k], "isCommitted": k != 1} for k, a in enumerate(([0], [0], [1]))]
    instructions.append({"transactionIndex": 0, "instructionAddress": [0, 1], "programId": "In", "accounts": [], "data": base58(b"\0\0x"), "isCommitted": True})
    one = {
        "header": header(),
        "transactions": [{"transactionIndex": k, "accountKeys": [f"fee{k}", "x"]} for k in range(3)],
        "instructions": instructions,
        "logs": [{"transactionIndex": k, "logIndex": k, "instructionAddress": [0], "programId": f"P{k}", "kind": "log", "message": "m"} for k in range(2)],
        "balances": [{"transactionIndex": k, "account": f"b{k}", "pre": "1", "post": "2"} for k in range(3)],
        "tokenBalances": [{"transactionIndex": k, "account": f"t{k}", "preMint": f"m{k}", "postMint": "M", "preOwner": f"o{k}", "postOwner": "O", "preProgramId": f"p{k}", "postProgramId": "P"} for k in range(3)],
        "rewards": [{"pubkey": f"r{k}", "lamports": "1"} for k in range(2)],
    }
    blocks = schemas.read_blocks(spark, write(tmp_path / "b", [one]), "solana")
    run = lambda kind, /, include=None, **fields: Query("solana").add_request(kind, include=include, **fields).run(blocks)
    tx = lambda kind, /, **fields: places(run(kind, **fields)[kind], "transactionIndex")
    assert tx("transactions", feePayer=["fee2"]) == [(2,)]
    assert tx("instructions", d8=["0x0102030405060701"]) == [(1,)] and tx("instructions", d1=["0x01"]) == tx("instructions", d4=["0x01020304"]) == [(0,), (1,), (2,)]
    assert tx("instructions", d2=["0x0000"]) == [(0,)] and tx("instructions", isCommitted=False) == [(1,)]
    for k in range(10):
        assert tx("instructions", **{f"a{k}": [f"acc{k}2"]}) == [(2,)]
    assert tx("logs", programId=["P1"], kind=["log"]) == [(1,)] and tx("balances", account=["b1"]) == [(1,)]
    for field, value in (("account", "t1"), ("preMint", "m1"), ("preOwner", "o1"), ("preProgramId", "p1")):
        assert tx("tokenBalances", **{field: [value]}, postMint=["M"], postOwner=["O"], postProgramId=["P"]) == [(1,)]
    assert places(run("rewards", pubkey=["r1"])["rewards"], "pubkey") == [("r1",)]
    inner = run("instructions", {"innerInstructions": True, "transaction": True, "transactionBalances": True, "transactionTokenBalances": True, "logs": True}, programId=["P0"])
    assert places(inner["instructions"], "instructionAddress") == [((0,),), ((0, 1),)]
    assert [inner[n].count() for n in ("transactions", "balances", "tokenBalances", "logs")] == [1] * 4
    assert run("instructions", {"transactionInstructions": True}, programId=["P0"])["instructions"].count() == 2
    assert places(run("logs", {"instruction": True}, programId=["P0"])["instructions"], "programId") == [("P0",)]
    assert run("balances", {"transactionInstructions": True}, account=["b0"])["instructions"].count() == 2
    assert run("transactions", {"instructions": True, "logs": True}, feePayer=["fee0"])["instructions"].count() == 2


def test_bitcoin_requests(spark, tmp_path):
    inputs = [{"transactionIndex": k, "inputIndex": 0, "type": ("tx", "coinbase")[k], "prevoutScriptPubKeyAddress": f"a{k}", "prevoutScriptPubKeyType": f"s{k}", "prevoutGenerated": bool(k)} for k in range(2)]
    outputs = [{"transactionIndex": k, "outputIndex": 0, "scriptPubKeyAddress": f"a{k}", "scriptPubKeyType": f"s{k}", "value": 0.5} for k in range(2)]
    blocks = schemas.read_blocks(spark, write(tmp_path / "b", [{"header": header(), "transactions": [{"transactionIndex": k, "txid": f"x{k}"} for k in range(2)], "inputs": inputs, "outputs": outputs}]), "bitcoin")
    run = lambda kind, /, include=None, **fields: Query("bitcoin").add_request(kind, include=include, **fields).run(blocks)
    for field, value in (("type", "coinbase"), ("prevoutScriptPubKeyAddress", "a1"), ("prevoutScriptPubKeyType", "s1"), ("prevoutGenerated", True)):
        assert places(run("inputs", **{field: [value]})["inputs"], "transactionIndex") == [(1,)]
    for field, value in (("scriptPubKeyAddress", "a1"), ("scriptPubKeyType", "s1")):
        out = run("outputs", {"transaction": True, "transactionInputs": True, "transactionOutputs": True}, **{field: [value]})
        assert [places(out[n], "transactionIndex") for n in ("outputs", "inputs", "transactions")] == [[(1,)]] * 3
    out = run("transactions", {"inputs": True, "outputs": True})
    assert [out[n].count() for n in ("transactions", "inputs", "outputs")] == [2, 2, 2]


def test_tron_requests(spark, tmp_path):
    value = lambda **v: json.dumps({"value": v, "type_url": "x"})
    txs = [
        {"transactionIndex": 0, "type": "TransferContract", "parameter": value(owner_address="41aa", to_address="41bb", amount=1)},
        {"transactionIndex": 1, "type": "TransferAssetContract", "parameter": value(owner_address="41aa", to_address="41cc", asset_name="31")},
        {"transactionIndex": 2, "type": "TriggerSmartContract", "parameter": value(owner_address="41dd", contract_address="41ee", data="A9059CBB00ff")},
    ]
    logs = [{"transactionIndex": 2, "logIndex": 0, "address": "ee", "topics": ["t0", "t1"], "data": ""}]
    internal = [{"transactionIndex": 2, "internalTransactionIndex": 0, "callerAddress": "41ee", "transferToAddress": "41ff"}]
    blocks = schemas.read_blocks(spark, write(tmp_path / "b", [{"header": header(), "transactions": txs, "logs": logs, "internalTransactions": internal}]), "tron")
    run = lambda kind, /, include=None, **fields: Query("tron").add_request(kind, include=include, **fields).run(blocks)
    tx = lambda kind, /, **fields: places(run(kind, **fields)["transactions"], "transactionIndex")
    assert tx("transferTransactions", owner=["41aa"], to=["41bb"]) == [(0,)] and tx("transferTransactions", to=["41cc"]) == []
    assert tx("transferAssetTransactions", to=["41cc"], asset=["31"]) == [(1,)]
    assert tx("triggerSmartContractTransactions", sighash=["a9059cbb"], contract=["41ee"], owner=["41dd"]) == [(2,)]
    assert tx("triggerSmartContractTransactions", sighash=["00000000"]) == [] and tx("transactions", type=["TransferContract"]) == [(0,)]
    included = run("triggerSmartContractTransactions", {"logs": True, "internalTransactions": True})
    assert included["logs"].count() == included["internalTransactions"].count() == 1
    assert run("logs", {"transaction": True}, address=["ee"], topic1=["t1"])["transactions"].count() == 1
    assert run("internalTransactions", {"transaction": True}, caller=["41ee"], transferTo=["41ff"])["transactions"].count() == 1


def test_fill_requests(spark, tmp_path):
    fills = [{"fillIndex": k, "user": f"u{k}", "coin": f"c{k}", "dir": f"d{k}", "cloid": f"l{k}", "feeToken": f"f{k}", "builder": f"b{k}"} for k in range(3)]
    blocks = schemas.read_blocks(spark, write(tmp_path / "b", [{"header": header(), "fills": fills}, {"header": header(2)}]), "hyperliquidFills")
    for field in ("user", "coin", "dir", "cloid", "feeToken", "builder"):
        value = fills[1][field]
        assert places(Query("hyperliquidFills").add_request("fills", **{field: [value]}).run(blocks)["fills"], "fillIndex") == [(1,)]
    assert places(Query("hyperliquidFills").include_all_blocks().run(blocks)["blocks"], "number") == [(1,), (2,)]


def test_substrate_requests(spark, tmp_path):
    args = json.dumps
    calls = [
        {"extrinsicIndex": 0, "address": [], "name": "Utility.batch", "args": "{}"},
        {"extrinsicIndex": 0, "address": [0], "name": "Ethereum.transact", "args": args({"transaction": {"value": {"action": {"value": "0xT0"}, "input": "0xA9059CBB01"}}})},
        {"extrinsicIndex": 0, "address": [0, 1], "name": "Balances.transfer", "args": "{}"},
        {"extrinsicIndex": 1, "address": [], "name": "Balances.transfer", "args": "{}"},
    ]
    events = [
        {"index": 0, "name": "EVM.Log", "args": args({"log": {"address": "0xAA", "topics": ["0xT1", "0xT2"]}}), "extrinsicIndex": 0, "callAddress": [0]},
        {"index": 1, "name": "Contracts.ContractEmitted", "args": args({"contract": "0xc"}), "extrinsicIndex": 1, "callAddress": []},
        {"index": 2, "name": "Gear.MessageQueued", "args": args({"destination": "0xp"}), "extrinsicIndex": 1, "callAddress": []},
        {"index": 3, "name": "Gear.UserMessageSent", "args": args({"message": {"source": "0xs"}}), "extrinsicIndex": 0, "callAddress": [0, 1]},
    ]
    blocks = schemas.read_blocks(spark, write(tmp_path / "b", [{"header": header(), "extrinsics": [{"index": k, "hash": f"0xe{k}"} for k in range(2)], "calls": calls, "events": events}]), "substrate")
    run = lambda kind, /, include=None, **fields: Query("substrate").add_request(kind, include=include, **fields).run(blocks)
    index = lambda kind, /, **fields: places(run(kind, **fields)["events"], "index")
    assert index("events", name=["EVM.Log", "Gear.MessageQueued"]) == [(0,), (2,)]
    assert index("evmLogs", address=["0xaa"]) == index("ethereumLogs", address=["0xaa"], topic0=["0xt1"], topic1=["0xt2"]) == [(0,)] and index("ethereumLogs", topic3=["0xt1"]) == []
    assert index("contractsEvents", address=["0xc"]) == [(1,)] and index("gearMessagesQueued", programId=["0xp"]) == [(2,)] and index("gearUserMessagesSent", programId=["0xs"]) == [(3,)]
    made = run("ethereumTransactions", {"extrinsic": True, "stack": True, "events": True}, to=["0xt0"], sighash=["0xa9059cbb"])
    assert places(made["calls"], "address") == [((),), ((0,),)] and places(made["extrinsics"], "index") == [(0,)] and places(made["events"], "index") == [(0,)]
    of_event = run("events", {"extrinsic": True, "call": True}, name=["Gear.UserMessageSent"])
    assert places(of_event["calls"], "address") == [((0, 1),)] and places(of_event["extrinsics"], "hash") == [("0xe0",)]
    assert places(run("events", {"stack": True}, name=["Gear.UserMessageSent"])["calls"], "address") == [((),), ((0,),)]
    assert places(run("calls", name=["Balances.transfer"])["calls"], "extrinsicIndex") == [(0,), (1,)]


def test_fields_and_ranges(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", [evm(n, [log(0, 0, "0xa")], [tx(0)]) for n in range(1, 5)])
    blocks = schemas.read_blocks(spark, path, "evm")
    q = Query("evm").add_fields({"log": {"address": True}, "block": {"timestamp": True}}).add_request("logs", Range(2, 3), {"transaction": True}, address=["0xa"]).add_range(Range(4))
    out = q.run(blocks)
    assert out["logs"].columns == ["block_number", "block_hash", "block_time", "ordinal", "transactionIndex", "address"]
    assert "from" in out["transactions"].columns and out["blocks"].columns == ["number", "hash", "timestamp"]
    assert places(out["logs"], "block_number") == [(2,), (3,)] == places(out["blocks"], "number")


def scanned(df):
    """The schema that the scan reads, and the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    (node,) = [n for n in leaves(df._jdf.queryExecution().executedPlan()) if "Scan" in n.nodeName()]
    return node.requiredSchema().catalogString(), plan


def leaves(plan):
    plan = plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    return [leaf for k in kids for leaf in leaves(k)] if kids else [plan]


PLACE = "header:struct<number:bigint,hash:string,timestamp:bigint>"
READS = [
    (
        Query("evm").add_fields({"log": {"address": True}, "transaction": {"hash": True}, "trace": {"type": True}}).add_request("logs", include={"transaction": True, "transactionTraces": True}, topic0=["0xt"]),
        PLACE + ",transactions:array<struct<transactionIndex:bigint,hash:string>>,logs:array<struct<transactionIndex:bigint,address:string,topics:array<string>>>,traces:array<struct<type:string,transactionIndex:bigint>>",
    ),
    (
        Query("evm").add_fields({"trace": {"action": {"to": True}}, "block": {"miner": True}}).add_request("traces", include={"parents": True, "subtraces": True}, callSighash=["0x1"]),
        "header:struct<number:bigint,hash:string,timestamp:bigint,miner:string>,traces:array<struct<type:string,transactionIndex:bigint,traceAddress:array<bigint>,action:struct<to:string,sighash:string>>>",
    ),
    (
        Query("solana").add_fields({"instruction": {"programId": True}, "transaction": {"signatures": True}}).add_request("instructions", include={"innerInstructions": True, "transaction": True}, a1=["x"], isCommitted=True),
        "header:struct<hash:string,number:bigint,timestamp:bigint>,transactions:array<struct<transactionIndex:bigint,signatures:array<string>>>,instructions:array<struct<transactionIndex:bigint,instructionAddress:array<bigint>,programId:string,accounts:array<string>,isCommitted:boolean>>",
    ),
    (
        Query("bitcoin").add_fields({"output": {"value": True}}).add_request("outputs", include={"transactionOutputs": True}, scriptPubKeyType=["s"]),
        PLACE + ",outputs:array<struct<transactionIndex:bigint,value:double,scriptPubKeyType:string>>",
    ),
    (
        Query("tron").add_fields({"log": {"data": True}}).add_request("triggerSmartContractTransactions", include={"logs": True}, owner=["41aa"]).add_fields({"transaction": {"fee": True}}),
        PLACE + ",transactions:array<struct<transactionIndex:bigint,hash:string,type:string,parameter:string,timestamp:bigint,fee:string>>,logs:array<struct<transactionIndex:bigint,data:string>>",
    ),
    (
        Query("hyperliquidFills").add_fields({"fill": {"coin": True}}).add_request("fills", user=["u"]),
        PLACE + ",fills:array<struct<user:string,coin:string,hash:string>>",
    ),
    (
        Query("substrate").add_fields({"call": {"name": True}, "event": {"name": True}, "extrinsic": {"success": True}}).add_request("evmLogs", include={"stack": True, "extrinsic": True}, address=["0x3"]),
        PLACE + ",extrinsics:array<struct<index:bigint,success:boolean,hash:string>>,calls:array<struct<extrinsicIndex:bigint,address:array<bigint>,name:string>>,events:array<struct<name:string,args:string,extrinsicIndex:bigint,callAddress:array<bigint>>>",
    ),
]


@pytest.mark.parametrize(("q", "expected"), READS, ids=lambda x: x.network if isinstance(x, Query) else "")
def test_scans_read_what_is_asked_for(spark, tmp_path, q, expected):
    """One scan of the clipped schema for each result, whatever it brings along, and no exchange."""
    path = str(tmp_path / "stored")
    spark.createDataFrame([], schemas.schema(q.network)).write.parquet(path)
    blocks = q.read(spark, path)
    assert blocks.drop("block_time").schema.simpleString() == f"struct<{expected}>"
    chosen = schemas.read_stored(spark, path, q.network, {"header": {"parentHash": True}})
    assert scanned(chosen)[0].startswith("struct<header:struct<") and "parentHash" in scanned(chosen)[0] and scanned(chosen)[0].count(":") == 5
    wanted = dict(part.split(":", 1) for part in re.split(r",(?=[a-zA-Z]+:(?:array|struct)<)", expected) if part.count("<") == part.count(">"))
    for entity, df in q.run(blocks).items():
        read, plan = scanned(df)
        assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
        assert all(f"{name}:{kind}" in expected for name, kind in wanted.items() if name in read)
        assert entity == "blocks" or "logsBloom" not in read
        assert df.count() == 0


def brute(rows, network, entity, wanted, flag):
    """The items by a loop over all pairs of a block."""
    relation = RELATIONS.get(f"{entity}.{flag}") or RELATIONS[flag]
    found = set()
    for b in rows:
        number = b["header"]["number"]
        for m in filter(wanted, b[entity]):
            for k, x in enumerate(b[relation.target]):
                if all(m[p] is not None and m[p] == x[q] for p, q in relation.keys):
                    if relation.path is None:
                        found.add((number, k))
                        continue
                    mine, theirs = m[relation.path[0]], x[relation.path[1]]
                    if mine is None or theirs is None:
                        continue
                    short, long = (mine, theirs) if relation.mode == "extension" else (theirs, mine)
                    if mine == theirs if relation.mode == "same" else len(short) < len(long) and long[: len(short)] == short:
                        found.add((number, k))
    return found


def test_related_items_equal_a_loop_over_pairs(spark, tmp_path):
    """All relations with paths and one without, with nulls, repeated items and blocks without some arrays."""
    rng = random.Random(9)
    path = lambda: rng.choice([None, [], [0], [1], [0, 1], [0, 1, 2], [1, 0], [0, 0, 0, 1]])
    some = lambda make: [make() for _ in range(rng.randint(0, 12))]
    index = lambda: rng.choice([None, 0, 1, 2])
    evm_rows = [{"header": header(n), "traces": some(lambda: {"transactionIndex": index(), "traceAddress": path(), "type": "call", "action": {"to": rng.choice("ab")}}), "logs": some(lambda: {"transactionIndex": index(), "address": rng.choice("ab")})} for n in range(30)]
    sub_rows = [{"header": header(n), "calls": some(lambda: {"extrinsicIndex": index(), "address": path(), "name": rng.choice("ab")}), "events": some(lambda: {"extrinsicIndex": index(), "callAddress": path(), "name": rng.choice("ab")}), "extrinsics": [{"index": i} for i in range(3)]} for n in range(30)]
    for network, rows, kind, entity, fields, wanted, flags in (
        ("evm", evm_rows, "traces", "traces", {"callTo": ["a"]}, lambda m: m["action"]["to"] == "a", ("parents", "subtraces", "transactionLogs")),
        ("evm", evm_rows, "logs", "logs", {"address": ["a"]}, lambda m: m["address"] == "a", ("transactionTraces", "transactionLogs")),
        ("substrate", sub_rows, "calls", "calls", {"name": ["a"]}, lambda m: m["name"] == "a", ("stack", "events", "extrinsic")),
        ("substrate", sub_rows, "events", "events", {"name": ["a"]}, lambda m: m["name"] == "a", ("stack", "call", "extrinsic")),
    ):
        blocks = schemas.read_blocks(spark, write(tmp_path / f"{network}{kind}", rows), network)
        for flag in flags:
            target = (RELATIONS.get(f"{entity}.{flag}") or RELATIONS[flag]).target
            out = Query(network).add_request(kind, Range(3, 25), {flag: True}, **fields).run(blocks)
            inside = [b for b in rows if 3 <= b["header"]["number"] <= 25]
            direct = {(b["header"]["number"], k) for b in inside for k, x in enumerate(b[entity]) if wanted(x)}
            expected = brute(inside, network, entity, wanted, flag) | (direct if target == entity else set())
            assert places(out[target], "block_number", "ordinal") == sorted(expected), (network, kind, flag)
            assert places(out["blocks"], "number") == sorted({(n,) for n, _ in direct})


def test_nested_selections_and_null_items(spark, tmp_path):
    path = write(tmp_path / "b", [evm(1, traces=[trace(0, 2), {"type": "create", "transactionIndex": 0, "traceAddress": [], "action": None}])])
    q = Query("evm").add_fields({"trace": {"type": True, "action": {"to": True}}}).add_request("traces")
    out = q.run(schemas.read_blocks(spark, path, "evm"))["traces"]
    assert [(r.type, r.action and r.action.asDict()) for r in out.collect()] == [("call", {"to": "0x2"}), ("create", None)]
    assert q.run(q.read(spark, path, "json"))["traces"].collect() == out.collect()
