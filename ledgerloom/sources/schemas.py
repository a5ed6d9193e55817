"""Block schemas by network: one row a block, a header and one array for each entity."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names and types of the wire format.
DDL = {
    "evm": (
        "header STRUCT<number: BIGINT, hash: STRING, parentHash: STRING, timestamp: BIGINT, transactionsRoot: STRING, receiptsRoot: STRING, "
        "stateRoot: STRING, logsBloom: STRING, sha3Uncles: STRING, extraData: STRING, miner: STRING, nonce: STRING, mixHash: STRING, size: BIGINT, "
        "gasLimit: STRING, gasUsed: STRING, difficulty: STRING, totalDifficulty: STRING, baseFeePerGas: STRING, blobGasUsed: STRING, "
        "excessBlobGas: STRING, l1BlockNumber: BIGINT, uncles: ARRAY<STRING>, withdrawalsRoot: STRING, withdrawals: ARRAY<STRUCT<index: STRING, "
        "validatorIndex: STRING, address: STRING, amount: STRING>>>, transactions ARRAY<STRUCT<transactionIndex: BIGINT, hash: STRING, "
        "nonce: STRING, `from`: STRING, `to`: STRING, input: STRING, value: STRING, gas: STRING, gasPrice: STRING, maxFeePerGas: STRING, "
        "maxPriorityFeePerGas: STRING, v: STRING, r: STRING, s: STRING, yParity: BIGINT, chainId: BIGINT, sighash: STRING, contractAddress: STRING, "
        "gasUsed: STRING, cumulativeGasUsed: STRING, effectiveGasPrice: STRING, type: BIGINT, status: BIGINT, logsBloom: STRING, "
        "blobVersionedHashes: ARRAY<STRING>, accessList: ARRAY<STRUCT<address: STRING, storageKeys: ARRAY<STRING>>>, l1Fee: STRING, "
        "l1FeeScalar: BIGINT, l1GasPrice: STRING, l1GasUsed: STRING, l1BlobBaseFee: STRING, l1BlobBaseFeeScalar: BIGINT, l1BaseFeeScalar: BIGINT>>, "
        "logs ARRAY<STRUCT<logIndex: BIGINT, transactionIndex: BIGINT, transactionHash: STRING, address: STRING, data: STRING, "
        "topics: ARRAY<STRING>>>, traces ARRAY<STRUCT<type: STRING, transactionIndex: BIGINT, traceAddress: ARRAY<BIGINT>, subtraces: BIGINT, "
        "error: STRING, revertReason: STRING, action: STRUCT<`from`: STRING, `to`: STRING, value: STRING, gas: STRING, init: STRING, "
        "callType: STRING, input: STRING, sighash: STRING, address: STRING, refundAddress: STRING, balance: STRING, author: STRING, type: STRING>, "
        "result: STRUCT<gasUsed: STRING, code: STRING, address: STRING, output: STRING>>>, stateDiffs ARRAY<STRUCT<transactionIndex: BIGINT, "
        "address: STRING, `key`: STRING, kind: STRING, prev: STRING, next: STRING>>"
    ),
    "solana": (
        "header STRUCT<hash: STRING, number: BIGINT, height: BIGINT, parentNumber: BIGINT, parentHash: STRING, timestamp: BIGINT>, "
        "transactions ARRAY<STRUCT<transactionIndex: BIGINT, version: STRING, accountKeys: ARRAY<STRING>, "
        "addressTableLookups: ARRAY<STRUCT<accountKey: STRING, readonlyIndexes: ARRAY<BIGINT>, writableIndexes: ARRAY<BIGINT>>>, "
        "numReadonlySignedAccounts: BIGINT, numReadonlyUnsignedAccounts: BIGINT, numRequiredSignatures: BIGINT, recentBlockhash: STRING, "
        "signatures: ARRAY<STRING>, err: STRING, computeUnitsConsumed: STRING, fee: STRING, loadedAddresses: STRUCT<readonly: ARRAY<STRING>, "
        "writable: ARRAY<STRING>>, hasDroppedLogMessages: BOOLEAN>>, instructions ARRAY<STRUCT<transactionIndex: BIGINT, "
        "instructionAddress: ARRAY<BIGINT>, programId: STRING, accounts: ARRAY<STRING>, data: STRING, computeUnitsConsumed: STRING, error: STRING, "
        "isCommitted: BOOLEAN, hasDroppedLogMessages: BOOLEAN>>, logs ARRAY<STRUCT<transactionIndex: BIGINT, logIndex: BIGINT, "
        "instructionAddress: ARRAY<BIGINT>, programId: STRING, kind: STRING, message: STRING>>, balances ARRAY<STRUCT<transactionIndex: BIGINT, "
        "account: STRING, pre: STRING, post: STRING>>, tokenBalances ARRAY<STRUCT<transactionIndex: BIGINT, account: STRING, preProgramId: STRING, "
        "preMint: STRING, preDecimals: BIGINT, preOwner: STRING, preAmount: STRING, postProgramId: STRING, postMint: STRING, postDecimals: BIGINT, "
        "postOwner: STRING, postAmount: STRING>>, rewards ARRAY<STRUCT<pubkey: STRING, lamports: STRING, postBalance: STRING, rewardType: STRING, "
        "commission: BIGINT>>"
    ),
    "bitcoin": (
        "header STRUCT<number: BIGINT, hash: STRING, parentHash: STRING, timestamp: BIGINT, medianTime: BIGINT, version: BIGINT, merkleRoot: STRING, "
        "nonce: BIGINT, target: STRING, bits: STRING, difficulty: DOUBLE, chainWork: STRING, strippedSize: BIGINT, size: BIGINT, weight: BIGINT>, "
        "transactions ARRAY<STRUCT<transactionIndex: BIGINT, hex: STRING, txid: STRING, hash: STRING, size: BIGINT, vsize: BIGINT, weight: BIGINT, "
        "version: BIGINT, locktime: BIGINT>>, inputs ARRAY<STRUCT<transactionIndex: BIGINT, inputIndex: BIGINT, type: STRING, txid: STRING, "
        "vout: BIGINT, scriptSigHex: STRING, scriptSigAsm: STRING, sequence: BIGINT, coinbase: STRING, txInWitness: ARRAY<STRING>, "
        "prevoutGenerated: BOOLEAN, prevoutHeight: BIGINT, prevoutValue: DOUBLE, prevoutScriptPubKeyHex: STRING, prevoutScriptPubKeyAsm: STRING, "
        "prevoutScriptPubKeyDesc: STRING, prevoutScriptPubKeyType: STRING, prevoutScriptPubKeyAddress: STRING>>, "
        "outputs ARRAY<STRUCT<transactionIndex: BIGINT, outputIndex: BIGINT, value: DOUBLE, scriptPubKeyHex: STRING, scriptPubKeyAsm: STRING, "
        "scriptPubKeyDesc: STRING, scriptPubKeyType: STRING, scriptPubKeyAddress: STRING>>"
    ),
    "tron": (
        "header STRUCT<number: BIGINT, hash: STRING, parentHash: STRING, txTrieRoot: STRING, version: BIGINT, timestamp: BIGINT, "
        "witnessAddress: STRING, witnessSignature: STRING>, transactions ARRAY<STRUCT<transactionIndex: BIGINT, hash: STRING, "
        "ret: ARRAY<STRUCT<contractRet: STRING>>, signature: ARRAY<STRING>, type: STRING, parameter: STRING, permissionId: BIGINT, "
        "refBlockBytes: STRING, refBlockHash: STRING, feeLimit: STRING, expiration: BIGINT, timestamp: BIGINT, rawDataHex: STRING, fee: STRING, "
        "contractResult: STRING, contractAddress: STRING, resMessage: STRING, withdrawAmount: STRING, unfreezeAmount: STRING, "
        "withdrawExpireAmount: STRING, cancelUnfreezeV2Amount: STRING, result: STRING, energyFee: STRING, energyUsage: STRING, "
        "energyUsageTotal: STRING, netUsage: STRING, netFee: STRING, originEnergyUsage: STRING, energyPenaltyTotal: STRING>>, "
        "logs ARRAY<STRUCT<transactionIndex: BIGINT, logIndex: BIGINT, address: STRING, data: STRING, topics: ARRAY<STRING>>>, "
        "internalTransactions ARRAY<STRUCT<transactionIndex: BIGINT, internalTransactionIndex: BIGINT, hash: STRING, callerAddress: STRING, "
        "transferToAddress: STRING, callValueInfo: ARRAY<STRUCT<callValue: STRING, tokenId: STRING>>, note: STRING, rejected: BOOLEAN, "
        "extra: STRING>>"
    ),
    "hyperliquidFills": (
        "header STRUCT<number: BIGINT, hash: STRING, parentHash: STRING, timestamp: BIGINT>, fills ARRAY<STRUCT<fillIndex: BIGINT, user: STRING, "
        "coin: STRING, px: DOUBLE, sz: DOUBLE, side: STRING, time: BIGINT, startPosition: DOUBLE, dir: STRING, closedPnl: DOUBLE, hash: STRING, "
        "oid: BIGINT, crossed: BOOLEAN, fee: DOUBLE, builderFee: DOUBLE, tid: BIGINT, cloid: STRING, feeToken: STRING, builder: STRING, "
        "twapId: BIGINT>>"
    ),
    "substrate": (
        "header STRUCT<number: BIGINT, hash: STRING, parentHash: STRING, stateRoot: STRING, extrinsicsRoot: STRING, "
        "digest: STRUCT<logs: ARRAY<STRING>>, specName: STRING, specVersion: BIGINT, implName: STRING, implVersion: BIGINT, timestamp: BIGINT, "
        "validator: STRING>, extrinsics ARRAY<STRUCT<index: BIGINT, version: BIGINT, signature: STRUCT<address: STRING, signature: STRING, "
        "signedExtensions: STRING>, fee: STRING, tip: STRING, error: STRING, success: BOOLEAN, hash: STRING>>, "
        "calls ARRAY<STRUCT<extrinsicIndex: BIGINT, address: ARRAY<BIGINT>, name: STRING, args: STRING, origin: STRING, error: STRING, "
        "success: BOOLEAN>>, events ARRAY<STRUCT<index: BIGINT, name: STRING, args: STRING, phase: STRING, extrinsicIndex: BIGINT, "
        "callAddress: ARRAY<BIGINT>, topics: ARRAY<STRING>>>"
    ),
}

#: Networks whose header time is in milliseconds.
MILLISECONDS = {"tron"}

Selection = Mapping[str, Any]


def schema(network: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[network])


def project(full: T.StructType, selection: Selection) -> T.StructType:
    """The fields whose entry in the selection is true; nested selections for nested fields, within arrays too."""

    def of(kind: T.DataType, chosen: Any) -> T.DataType:
        if chosen is True or not isinstance(chosen, Mapping):
            return kind
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(of(kind.elementType, chosen))
        return project(kind, chosen)

    return T.StructType([T.StructField(f.name, of(f.dataType, selection[f.name])) for f in full.fields if selection.get(f.name)])


def merge_fields(a: Selection, b: Selection) -> dict[str, Any]:
    """Both selections; of two plain values the second counts, a plain one replaces a tree and the other way round."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merge_fields(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def clipped(network: str, selection: Selection | None) -> T.StructType:
    """What a reader has to read: the selected fields and those that say which block it is; the whole schema without a selection."""
    return schema(network) if selection is None else project(schema(network), merge_fields(selection, {"header": _block(selection.get("header"))}))


def _block(chosen: Any) -> Any:
    return True if chosen is True else {"number": True, "hash": True, "timestamp": True}


def read_blocks(spark: SparkSession, path: str, network: str, selection: Selection | None = None) -> DataFrame:
    """Blocks from JSON lines. What isn't selected isn't parsed; a line that doesn't fit the schema fails the job.

    Selected arrays that a block lacks are empty, header time comes as `block_time` besides.
    """
    return normalized(spark.read.schema(clipped(network, selection)).option("mode", "FAILFAST").json(path), network)


def read_stored(spark: SparkSession, path: str, network: str, selection: Selection | None = None) -> DataFrame:
    """Blocks from Parquet. The reader's own schema is clipped to the selection, so other fields, nested ones too, aren't read."""
    return normalized(spark.read.schema(clipped(network, selection)).parquet(path), network)


def picked(column: Column, kind: T.DataType, chosen: Any = True) -> Column:
    """The selected fields of a nested column, within arrays too; null stays null."""
    if not isinstance(chosen, Mapping):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: picked(x, kind.elementType, chosen))
    fields = [f for f in kind.fields if chosen.get(f.name)]
    return F.when(column.isNotNull(), F.struct(*[picked(column.getField(f.name), f.dataType, chosen[f.name]).alias(f.name) for f in fields]))


def normalized(blocks: DataFrame, network: str) -> DataFrame:
    arrays = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in blocks.schema.fields if isinstance(f.dataType, T.ArrayType)}
    time = F.col("header.timestamp")
    return blocks.withColumns(arrays).withColumn("block_time", F.timestamp_millis(time) if network in MILLISECONDS else F.timestamp_seconds(time))


def items(blocks: DataFrame, entity: str) -> DataFrame:
    """One row for each item of an entity, with its block's number, hash and time; `ordinal` is its place in the array."""
    at = blocks.select(F.col("header.number").alias("block_number"), F.col("header.hash").alias("block_hash"), "block_time", F.posexplode(entity).alias("ordinal", "item"))
    return at.select("block_number", "block_hash", "block_time", "ordinal", "item.*")
