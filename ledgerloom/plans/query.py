"""Declarative queries: per-entity requests over block ranges, and a selection of fields."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import bound_once, query_hash
from ledgerloom.operators.filters import either, in_range, request_predicate
from ledgerloom.sources import schemas

from .ranges import Range, bound, merge

#: Request kinds by network and the entity that they select (fixed values).
REQUESTS = {
    "evm": {"logs": "logs", "transactions": "transactions", "traces": "traces", "stateDiffs": "stateDiffs"},
    "solana": {"transactions": "transactions", "instructions": "instructions", "logs": "logs", "balances": "balances", "tokenBalances": "tokenBalances", "rewards": "rewards"},
    "bitcoin": {"transactions": "transactions", "inputs": "inputs", "outputs": "outputs"},
    "tron": {
        "transactions": "transactions",
        "transferTransactions": "transactions",
        "transferAssetTransactions": "transactions",
        "triggerSmartContractTransactions": "transactions",
        "logs": "logs",
        "internalTransactions": "internalTransactions",
    },
    "hyperliquidFills": {"fills": "fills"},
    "substrate": {
        "events": "events",
        "calls": "calls",
        "evmLogs": "events",
        "ethereumLogs": "events",
        "ethereumTransactions": "calls",
        "contractsEvents": "events",
        "gearMessagesQueued": "events",
        "gearUserMessagesSent": "events",
    },
}
#: What the narrower request kinds imply (fixed values).
IMPLIED = {
    "transferTransactions": {"type": ["TransferContract"]},
    "transferAssetTransactions": {"type": ["TransferAssetContract"]},
    "triggerSmartContractTransactions": {"type": ["TriggerSmartContract"]},
    "evmLogs": {"name": ["EVM.Log"]},
    "ethereumLogs": {"name": ["EVM.Log"]},
    "ethereumTransactions": {"name": ["Ethereum.transact"]},
    "contractsEvents": {"name": ["Contracts.ContractEmitted"]},
    "gearMessagesQueued": {"name": ["Gear.MessageQueued"]},
    "gearUserMessagesSent": {"name": ["Gear.UserMessageSent"]},
}
#: Request fields that mean something else in these kinds: the name of the derived column.
RENAMED = {
    "transferTransactions": {"to": "recipient"},
    "transferAssetTransactions": {"to": "recipient"},
    "triggerSmartContractTransactions": {"sighash": "inputSighash"},
    "evmLogs": {"address": "logAddress"},
    "ethereumLogs": {"address": "logAddress", **{f"topic{i}": f"logTopic{i}" for i in range(4)}},
    "ethereumTransactions": {"to": "transactTo", "sighash": "transactSighash"},
    "contractsEvents": {"address": "contractAddress"},
    "gearMessagesQueued": {"programId": "messageTarget"},
    "gearUserMessagesSent": {"programId": "messageSource"},
}


@dataclass(frozen=True)
class Relation:
    """Items of `target` that belong to a match: equal columns (of the match: of the target), and on request a path of
    positions that is the same, a `prefix` of the match's, or an `extension` of it (itself left out)."""

    target: str
    keys: tuple[tuple[str, str], ...] = (("transactionIndex", "transactionIndex"),)
    path: tuple[str, str] | None = None
    mode: str = "same"

    def known(self, source: str, test: Callable) -> Column:
        """The distinct keys that items of the matches' transactions have to have, from the array of the source entity; none of them is null."""
        columns = [a for a, _ in self.keys] + ([self.path[0]] if self.path else [])
        there = lambda x: reduce(lambda p, q: p & q, [x.getField(c).isNotNull() for c in columns])
        deep = lambda x: F.size(x.getField(self.path[0])) > 0 if self.mode == "prefix" else F.lit(True)
        found = F.filter(source, lambda x, i: test(x, i) & there(x) & deep(x))
        if self.mode != "prefix":
            return F.array_distinct(F.transform(found, lambda x: self._key(x, 0, self.path and x.getField(self.path[0]))))
        above = lambda x: F.transform(F.sequence(F.lit(0), F.size(x.getField(self.path[0])) - 1), lambda n: self._key(x, 0, F.slice(x.getField(self.path[0]), F.lit(1), n)))
        return F.array_distinct(F.flatten(F.transform(found, above)))

    def holds(self, item: Column, known: Column) -> Column:
        """Whether an item of the target has one of the keys."""
        columns = [b for _, b in self.keys] + ([self.path[1]] if self.path else [])
        there = reduce(lambda p, q: p & q, [item.getField(c).isNotNull() for c in columns])
        path = item.getField(self.path[1]) if self.path else None
        if self.mode != "extension":
            return there & F.array_contains(known, self._key(item, 1, path))
        above = F.sequence(F.lit(0), F.size(path) - 1)
        return there & (F.size(path) > 0) & F.exists(above, lambda n: F.array_contains(known, self._key(item, 1, F.slice(path, F.lit(1), n))))

    def _key(self, item: Column, side: int, path: Column | None) -> Column:
        keys = [item.getField(pair[side]).cast("bigint") for pair in self.keys]
        return keys[0] if path is None and len(keys) == 1 else F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *([path.cast("array<bigint>").alias("path")] if path is not None else []))


_IN_EXTRINSIC = (("extrinsicIndex", "extrinsicIndex"),)
#: What a match of an entity can bring along.
RELATIONS = {
    **{
        flag: Relation(target)
        for flag, target in {
            "transaction": "transactions",
            "transactionLogs": "logs",
            "transactionTraces": "traces",
            "transactionStateDiffs": "stateDiffs",
            "transactionInstructions": "instructions",
            "transactionBalances": "balances",
            "transactionTokenBalances": "tokenBalances",
            "transactionInputs": "inputs",
            "transactionOutputs": "outputs",
            "logs": "logs",
            "traces": "traces",
            "stateDiffs": "stateDiffs",
            "instructions": "instructions",
            "inputs": "inputs",
            "outputs": "outputs",
            "internalTransactions": "internalTransactions",
        }.items()
    },
    "parents": Relation("traces", path=("traceAddress", "traceAddress"), mode="prefix"),
    "subtraces": Relation("traces", path=("traceAddress", "traceAddress"), mode="extension"),
    "innerInstructions": Relation("instructions", path=("instructionAddress", "instructionAddress"), mode="extension"),
    "instruction": Relation("instructions", path=("instructionAddress", "instructionAddress")),
    "extrinsic": Relation("extrinsics", (("extrinsicIndex", "index"),)),
    "call": Relation("calls", _IN_EXTRINSIC, ("callAddress", "address")),
    "events": Relation("events", _IN_EXTRINSIC, ("address", "callAddress")),
    "calls.stack": Relation("calls", _IN_EXTRINSIC, ("address", "address"), "prefix"),
    "events.stack": Relation("calls", _IN_EXTRINSIC, ("callAddress", "address"), "prefix"),
}
#: Names in a field selection and the entities that they select from.
SELECTED = {
    "block": "blocks", "transaction": "transactions", "log": "logs", "trace": "traces", "stateDiff": "stateDiffs", "instruction": "instructions", "balance": "balances",
    "tokenBalance": "tokenBalances", "reward": "rewards", "input": "inputs", "output": "outputs", "internalTransaction": "internalTransactions", "fill": "fills",
    "extrinsic": "extrinsics", "call": "calls", "event": "events",
}
#: Columns that an item always has: where it is.
PLACE = ("block_number", "block_hash", "block_time", "ordinal", "transactionIndex", "extrinsicIndex", "number", "hash", "timestamp")


@dataclass(frozen=True)
class Request:
    kind: str
    range: Range
    fields: Mapping[str, Any] = field(default_factory=dict)
    include: frozenset[str] = frozenset()


#: Requests of one entity: their block ranges and field values.
Wanted = list[tuple[Range, dict[str, Any]]]


@dataclass(frozen=True)
class Query:
    """Immutable; each call returns a new one."""

    network: str
    fields: Mapping[str, Any] = field(default_factory=dict)
    requests: tuple[Request, ...] = ()
    ranges: tuple[Range, ...] = ()
    all_blocks: tuple[Range, ...] = ()

    def add_fields(self, fields: Mapping[str, Any]) -> Query:
        return replace(self, fields=schemas.merge_fields(self.fields, fields))

    def add_range(self, over: Range) -> Query:
        return replace(self, ranges=(*self.ranges, over))

    def add_request(self, kind: str, /, over: Range = Range(0), include: Mapping[str, bool] | None = None, **fields: Any) -> Query:
        if kind not in REQUESTS[self.network]:
            raise ValueError(f"{self.network} has no request {kind}")
        return replace(self, requests=(*self.requests, Request(kind, over, fields, frozenset(k for k, v in (include or {}).items() if v))))

    def include_all_blocks(self, over: Range = Range(0)) -> Query:
        return replace(self, all_blocks=(*self.all_blocks, over))

    def merge(self, other: Query) -> Query:
        """The other's requests first, the fields of both."""
        return Query(self.network, schemas.merge_fields(other.fields, self.fields), other.requests + self.requests, other.ranges + self.ranges, other.all_blocks + self.all_blocks)

    def segments(self, limit: Range = Range(0)) -> list[tuple[Range, list[Request]]]:
        """Disjoint block ranges within the limit, each with the requests that hold there."""
        given = [(r.range, r) for r in self.requests] + [(r, None) for r in (*self.ranges, *self.all_blocks)]
        out = []
        for over, held in merge(given):
            out += [(r, [h for h in held if h is not None]) for r in bound([over], limit)]
        return out if given else [(limit, [])]

    def hash(self) -> str:
        listed = [{"kind": r.kind, **dict(r.fields), "include": sorted(r.include)} for r in self.requests]
        return query_hash({"type": self.network, "fields": dict(self.fields), "requests": listed})

    def needed(self) -> dict[str, Any]:
        """The fields that the scan has to read: selected ones, those that requests and related items look at, and an item's place.

        Of an entity that the selection doesn't name, all fields; of the header only a block's place, unless there is no selection at all.
        """
        full = {f.name: f.dataType.elementType for f in schemas.schema(self.network).fields if f.name != "header"}
        out: dict[str, Any] = {"header": self._chosen("blocks") or bool(not self.fields) or {}}

        def add(entity: str, names: Iterable[str]) -> None:
            for name in names:
                top, *rest = name.split(".")
                if top in full[entity].names:
                    tree = reduce(lambda tree, part: {part: tree}, reversed(rest), True)
                    out[entity] = _both(out.get(entity), {top: tree})

        direct, brought = self._plan()
        for entity in dict.fromkeys([*direct, *brought]):
            out[entity] = _both(out.get(entity), self._chosen(entity) or True)
            add(entity, PLACE)
        for entity, wanted in [*direct.items(), *((source, w) for parts in brought.values() for source, _, w in parts)]:
            met: list[str] = []
            for _, fields in wanted:
                request_predicate(fields, full[entity].names, lambda name, met=met: (met.append(name), F.col(name))[1])
            add(entity, met)
        for target, parts in brought.items():
            for source, relation, _ in parts:
                pairs = [*relation.keys, *([relation.path] if relation.path else [])]
                add(source, [a for a, _ in pairs])
                add(target, [b for _, b in pairs])
        return out

    def read(self, spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
        """Blocks with the fields that `run` needs of them, and no other: the reader's schema is clipped. form: parquet, or json for lines of it."""
        return {"parquet": schemas.read_stored, "json": schemas.read_blocks}[form](spark, path, self.network, self.needed())

    def run(self, blocks: DataFrame, limit: Range = Range(0)) -> dict[str, DataFrame]:
        """The selected items by entity, `blocks` among them: each item once, whatever number of requests it fits.

        Blocks are those with a selected item, and all in the ranges of `include_all_blocks`. Of an entity that the field
        selection names, only the selected fields and an item's place are returned.

        All that belongs together lies in the row of its block, so items, related ones too, are picked from its arrays: each result is one
        scan, without an exchange.
        """
        number = F.col("header.number")
        asked = [r.range for r in self.requests] + [*self.ranges, *self.all_blocks]
        inside = blocks.where(in_range(number, limit) & (either([in_range(number, r) for r in asked]) if asked else F.lit(True)))
        direct, brought = self._plan()
        place = [number.alias("block_number"), F.col("header.hash").alias("block_hash"), F.col("block_time")]
        out = {}
        for entity in dict.fromkeys([*direct, *brought]):
            picked = inside.select(*place, F.explode(self._picked(inside, entity, direct.get(entity), brought.get(entity, []))).alias("item"))
            out[entity] = picked.select("block_number", "block_hash", "block_time", "item.*")
        has_item = [F.exists(F.transform(entity, self._test(inside, entity, wanted)), lambda found: found) for entity, wanted in direct.items()]
        kept = inside.where(either([*has_item, *[in_range(number, r) for r in self.all_blocks]]))
        chosen, kind = self._chosen("blocks"), inside.schema["header"].dataType
        names = [f for f in kind.fields if chosen is None or f.name in PLACE or chosen.get(f.name)]
        out["blocks"] = kept.select(*[schemas.picked(F.col("header").getField(f.name), f.dataType, _of(chosen, f.name)).alias(f.name) for f in names])
        return out

    def _chosen(self, entity: str) -> Mapping[str, Any] | None:
        """The selected fields of an entity; None for all."""
        return next((c for name, c in self.fields.items() if SELECTED.get(name) == entity and isinstance(c, Mapping)), None)

    def _plan(self) -> tuple[dict[str, Wanted], dict[str, list[tuple[str, Relation, Wanted]]]]:
        """What is asked for by entity, and by entity what matches of others bring along."""
        direct: dict[str, Wanted] = {}
        brought: dict[str, list[tuple[str, Relation, Wanted]]] = {}
        for kind in dict.fromkeys(r.kind for r in self.requests):
            own = [r for r in self.requests if r.kind == kind]
            entity = REQUESTS[self.network][kind]
            direct.setdefault(entity, []).extend(self._wanted(kind, r) for r in own)
            for flag in dict.fromkeys(f for r in own for f in sorted(r.include)):
                relation = RELATIONS.get(f"{entity}.{flag}") or RELATIONS[flag]
                brought.setdefault(relation.target, []).append((entity, relation, [self._wanted(kind, r) for r in own if flag in r.include]))
        return direct, brought

    @staticmethod
    def _wanted(kind: str, request: Request) -> tuple[Range, dict[str, Any]]:
        renamed = RENAMED.get(kind, {})
        return request.range, {**IMPLIED.get(kind, {}), **{renamed.get(k, k): v for k, v in request.fields.items()}}

    @staticmethod
    def _test(blocks: DataFrame, entity: str, wanted: Wanted) -> Callable:
        """Whether an item is asked for, as a function of it and its index."""
        names, number = blocks.schema[entity].dataType.elementType.names, F.col("header.number")

        def test(item: Column, i: Column) -> Column:
            at = lambda name: reduce(lambda x, part: x.getField(part), name.split("."), item)
            return either([in_range(number, over) & request_predicate(fields, names, at) for over, fields in wanted])

        return test

    def _picked(self, blocks: DataFrame, entity: str, wanted: Wanted | None, brought: list[tuple[str, Relation, Wanted]]) -> Column:
        """The array of an entity's items that are asked for or brought along, with their places in the whole array."""
        kind, chosen = blocks.schema[entity].dataType.elementType, self._chosen(entity)
        names = [f for f in kind.fields if chosen is None or f.name in PLACE or chosen.get(f.name)]
        known = [relation.known(entity_of, self._test(blocks, entity_of, w)) for entity_of, relation, w in brought]

        def of(sets: Sequence[Column]) -> Column:
            def pick(x: Column, i: Column) -> Column:
                tests = [self._test(blocks, entity, wanted)(x, i)] if wanted is not None else []
                tests += [relation.holds(x, held) for (_, relation, _), held in zip(brought, sets, strict=True)]
                item = F.struct(i.alias("ordinal"), *[schemas.picked(x.getField(f.name), f.dataType, _of(chosen, f.name)).alias(f.name) for f in names])
                return F.when(either([F.coalesce(t, F.lit(False)) for t in tests]), item)

            return F.array_compact(F.transform(entity, pick))

        return bound_once(known, of)


def _of(chosen: Mapping[str, Any] | None, name: str) -> Any:
    return True if chosen is None else chosen.get(name) or True


def _both(a: Any, b: Any) -> Any:
    """Fields of both selections; all fields if one of them takes all."""
    if a is None or b is None:
        return b if a is None else a
    if not (isinstance(a, Mapping) and isinstance(b, Mapping)):
        return True
    return {k: _both(a.get(k), b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
