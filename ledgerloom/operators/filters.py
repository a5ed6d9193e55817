"""Request filters: fields are ANDed, listed values ORed, requests of one kind ORed.

A missing field is no constraint; an empty list matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import base58
from ledgerloom.plans.ranges import Range

Values = Sequence[str | int | bool] | str | int | bool


def any_of(column: Column, values: Values | None) -> Column | None:
    """column IN values; None stands for no constraint."""
    if values is None:
        return None
    listed = [values] if isinstance(values, (str, int, bool)) else list(values)
    return column.isin(listed) if listed else F.lit(False)


def all_of(terms: Sequence[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def either(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


#: A column of an item by its name, dotted for what is nested.
At = Callable[[str], Column]
#: How the fields of a request are found in an item of its entity, where that isn't a column of their name.
FIELD_COLUMNS = {
    **{f"topic{i}": (lambda i: lambda at: F.get(at("topics"), i))(i) for i in range(4)},
    **{f"a{i}": (lambda i: lambda at: F.get(at("accounts"), i))(i) for i in range(10)},
    **{f"d{n}": (lambda n: lambda at: F.substring(F.lower(at("data_hex")), 1, 2 + 2 * n))(n) for n in (1, 2, 4, 8)},
    "feePayer": lambda at: F.get(at("accountKeys"), 0),
    "createFrom": lambda at: at("action.from"),
    "callFrom": lambda at: at("action.from"),
    "callTo": lambda at: at("action.to"),
    "callSighash": lambda at: at("action.sighash"),
    "suicideRefundAddress": lambda at: at("action.refundAddress"),
    "rewardAuthor": lambda at: at("action.author"),
    "owner": lambda at: F.get_json_object(at("parameter"), "$.value.owner_address"),
    "contract": lambda at: F.get_json_object(at("parameter"), "$.value.contract_address"),
    "asset": lambda at: F.get_json_object(at("parameter"), "$.value.asset_name"),
    "recipient": lambda at: F.get_json_object(at("parameter"), "$.value.to_address"),
    "inputSighash": lambda at: F.left(F.lower(F.get_json_object(at("parameter"), "$.value.data")), F.lit(8)),
    "logAddress": lambda at: F.lower(F.coalesce(F.get_json_object(at("args"), "$.log.address"), F.get_json_object(at("args"), "$.address"))),
    **{f"logTopic{i}": (lambda i: lambda at: F.lower(F.coalesce(F.get_json_object(at("args"), f"$.log.topics[{i}]"), F.get_json_object(at("args"), f"$.topics[{i}]"))))(i) for i in range(4)},
    "transactTo": lambda at: F.lower(F.get_json_object(at("args"), "$.transaction.value.action.value")),
    "transactSighash": lambda at: F.left(F.lower(F.get_json_object(at("args"), "$.transaction.value.input")), F.lit(10)),
    "contractAddress": lambda at: F.get_json_object(at("args"), "$.contract"),
    "messageTarget": lambda at: F.get_json_object(at("args"), "$.destination"),
    "messageSource": lambda at: F.get_json_object(at("args"), "$.message.source"),
    "caller": lambda at: at("callerAddress"),
    "transferTo": lambda at: at("transferToAddress"),
}

#: Fields of the instruction filter that name the first bytes of the data, and their number.
FIRST_BYTES = {"d1": 1, "d2": 2, "d4": 4, "d8": 8}
#: Fields of the trace filter that only traces of one type have.
TRACE_TYPES = {"createFrom": "create", "callFrom": "call", "callTo": "call", "callSighash": "call", "suicideRefundAddress": "suicide", "rewardAuthor": "reward"}


def column_at(name: str) -> Column:
    """The column of a table; only what is nested is dotted."""
    return F.col(name)


def request_predicate(fields: Mapping[str, Values | None], columns: Sequence[str] = (), at: At = column_at) -> Column:
    """One request as a predicate. columns: those of the table, which win over derived fields; at: where they are found.

    First bytes of data are looked for in `data_hex`; where a table has only `data`, in its base-58 text.
    """
    terms: list[Column | None] = []
    for name, values in fields.items():
        if name in FIRST_BYTES and name not in columns and "data_hex" not in columns and "data" in columns and values is not None:
            terms.append(base58.one_of(at("data"), FIRST_BYTES[name], [values] if isinstance(values, str) else list(values)))
            continue
        column = at(name) if name in columns or name not in FIELD_COLUMNS else FIELD_COLUMNS[name](at)
        term = any_of(column, values)
        if term is not None and name in TRACE_TYPES and "type" in columns:
            term = term & (at("type") == TRACE_TYPES[name])
        terms.append(term)
    return all_of(terms)


def in_range(number: Column, over: Range) -> Column:
    """Inclusive; an open end has no upper bound."""
    return number >= over.low if over.high is None else number.between(over.low, over.high)


def match(rows: DataFrame, requests: Sequence[tuple[Range, Mapping[str, Values | None]]], number: str = "block_number") -> DataFrame:
    """The rows that any of the requests selects within its block range; each once."""
    return rows.where(either([in_range(F.col(number), over) & request_predicate(fields, rows.columns) for over, fields in requests]))


def include_all_blocks(headers: DataFrame, matches: DataFrame, number: str = "block_number") -> DataFrame:
    """Every header with its matches; blocks without one appear once with nulls."""
    return headers.join(matches, number, "left")


def related(matches: DataFrame, others: DataFrame, keys: Sequence[str] = ("block_number", "transaction_index")) -> DataFrame:
    """The rows of another entity that share the keys with a match, each once."""
    return others.join(matches.select(*keys), list(keys), "left_semi")


def dispatch(topic0: Column, events: Sequence[tuple[str, str]]) -> Column:
    """The name of the first declared event (name, topic0) that a log fits; null for none."""
    out = F.lit(None).cast("string")
    for name, topic in reversed(events):
        out = F.when(topic0 == topic, name).otherwise(out)
    return out


def split_by_floor(rows: DataFrame, floor: int | None, number: str = "block_number") -> tuple[DataFrame, DataFrame]:
    """(finalized, not finalized): at or below the floor, and above it. Without a floor all rows are final."""
    if floor is None:
        return rows, rows.where(F.lit(False))
    final = F.col(number) <= floor
    return rows.where(final), rows.where(~final)
