"""Contract events and calls: canonical signatures, topics, and decoding.

All types are decoded by Spark expressions, without a Python worker: static words by their fixed places, dynamic types (`string`, `bytes`,
arrays, tuples with such parts) by following offsets from the head to the tail, where an array is a function over its indices. Integers up
to 63 bits become BIGINT, up to 120 DECIMAL(38,0), wider ones decimal text. Data that can't be decoded raise; `on_error="null"` gives
null instead. `decode` does the same for single values on the driver.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keccak import keccak256
from .scalars import bound_once

_ARRAY = re.compile(r"(.*)\[(\d*)\]")


@dataclass(frozen=True)
class Param:
    """A parameter of an event or function; tuples have components."""

    name: str
    type: str
    indexed: bool = False
    components: tuple[Param, ...] = ()

    @classmethod
    def of(cls, item: dict, position: int = 0) -> Param:
        parts = tuple(cls.of(c, i) for i, c in enumerate(item.get("components", ())))
        return cls(item.get("name") or f"_{position}", item["type"], bool(item.get("indexed")), parts)

    @property
    def canonical(self) -> str:
        if not self.type.startswith("tuple"):
            return {"uint": "uint256", "int": "int256"}.get(self.type, self.type)
        return f"({','.join(c.canonical for c in self.components)}){self.type[5:]}"

    @property
    def element(self) -> tuple[Param, int | None] | None:
        """Of an array: its element and fixed length (None: any)."""
        m = _ARRAY.fullmatch(self.type)
        return (Param(self.name, m[1], False, self.components), int(m[2]) if m[2] else None) if m else None

    @property
    def dynamic(self) -> bool:
        if self.element:
            inner, length = self.element
            return length is None or inner.dynamic
        return self.type in ("string", "bytes") or self.type == "tuple" and any(c.dynamic for c in self.components)

    @property
    def words(self) -> int:
        """Words that it takes in the head."""
        if self.dynamic:
            return 1
        if self.element:
            inner, length = self.element
            return inner.words * length
        return sum(c.words for c in self.components) if self.type == "tuple" else 1

    @property
    def bits(self) -> int | None:
        m = re.fullmatch(r"(u?)int(\d*)", self.type)
        return int(m[2] or 256) if m else None

    @property
    def spark(self) -> T.DataType:
        if self.element:
            return T.ArrayType(self.element[0].spark)
        if self.type == "tuple":
            return T.StructType([T.StructField(c.name, c.spark) for c in self.components])
        if self.bits:
            signed = not self.type.startswith("u")
            return T.LongType() if self.bits <= (64 if signed else 56) else T.DecimalType(38, 0) if self.bits <= 120 else T.StringType()
        if self.type == "bool":
            return T.BooleanType()
        if self.type in ("address", "string", "bytes") or re.fullmatch(r"bytes([1-9]|[12]\d|3[0-2])", self.type):
            return T.StringType()
        raise ValueError(f"unsupported type {self.type}")


@dataclass(frozen=True)
class Event:
    name: str
    params: tuple[Param, ...] = field(default=())

    @property
    def signature(self) -> str:
        return f"{self.name}({','.join(p.canonical for p in self.params)})"

    @property
    def topic0(self) -> str:
        return "0x" + keccak256(self.signature.encode()).hex()

    @property
    def indexed(self) -> list[Param]:
        return [p for p in self.params if p.indexed]

    @property
    def plain(self) -> list[Param]:
        return [p for p in self.params if not p.indexed]

    @property
    def spark(self) -> T.StructType:
        """Indexed parameters of dynamic types are only known by their hash."""
        return T.StructType([T.StructField(p.name, T.StringType() if p.indexed and _hashed(p) else p.spark) for p in self.params])


@dataclass(frozen=True)
class Function(Event):
    outputs: tuple[Param, ...] = ()
    view: bool = False

    @property
    def selector(self) -> str:
        return self.topic0[:10]


def _hashed(p: Param) -> bool:
    return p.dynamic or p.element is not None or p.type == "tuple"


def define(items: Sequence[dict] | dict) -> tuple[dict[str, Event], dict[str, Function]]:
    """Events and functions of an ABI by name. Anonymous events are left out; of equal names the first counts."""
    events: dict[str, Event] = {}
    functions: dict[str, Function] = {}
    for item in items["abi"] if isinstance(items, dict) else items:
        params = tuple(Param.of(x, i) for i, x in enumerate(item.get("inputs", ())))
        for p in params:
            p.spark  # noqa: B018  unsupported types are refused here
        if item.get("type") == "event" and not item.get("anonymous"):
            events.setdefault(item["name"], Event(item["name"], params))
        elif item.get("type") == "function":
            outputs = tuple(Param.of(x, i) for i, x in enumerate(item.get("outputs", ())))
            functions.setdefault(item["name"], Function(item["name"], params, outputs, item.get("stateMutability") in ("view", "pure")))
    return events, functions


def _param_list(text: str) -> list[dict]:
    """[{type, name?, indexed?}] of a comma-separated list such as `address indexed from, uint256 value`."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        words = part.split()
        out.append({"type": words[0], "indexed": "indexed" in words, "name": words[-1] if len(words) > 1 and words[-1] != "indexed" else ""})
    return out


def event(text: str) -> Event:
    """An event from text without tuples, as in `Transfer(address indexed from, address indexed to, uint256 value)`."""
    name, _, rest = text.partition("(")
    return Event(name.strip(), tuple(Param.of(x, i) for i, x in enumerate(_param_list(rest.rstrip(") ")))))


#: The events of a fungible token.
ERC20 = {e.name: e for e in (event("Transfer(address indexed from, address indexed to, uint256 value)"), event("Approval(address indexed owner, address indexed spender, uint256 value)"))}


# --- single values, for tests, filters and the UDF --------------------------------------------------------------------


def encode_word(p: Param, value: Any) -> str:
    """A static value as 64 hex digits."""
    if p.bits:
        return f"{int(value) % (1 << 256):064x}"
    if p.type == "bool":
        return f"{int(bool(value)):064x}"
    if p.type == "address":
        return value.lower().removeprefix("0x").rjust(64, "0")
    return value.removeprefix("0x").ljust(64, "0")


def encode(params: Sequence[Param], values: Sequence[Any]) -> str:
    """Hex of values in head and tail form, without 0x."""
    head, tail = [], []
    size = 32 * sum(p.words for p in params)
    for p, v in zip(params, values, strict=True):
        if p.dynamic:
            head.append(f"{size + sum(map(len, tail)) // 2:064x}")
            tail.append(_encode_one(p, v))
        else:
            head.append(_encode_one(p, v))
    return "".join(head + tail)


def _encode_one(p: Param, v: Any) -> str:
    if p.element:
        inner, length = p.element
        return ("" if length is not None else f"{len(v):064x}") + encode([inner] * len(v), v)
    if p.type == "tuple":
        return encode(p.components, [v[c.name] for c in p.components] if isinstance(v, dict) else v)
    if p.type in ("string", "bytes"):
        data = v.encode().hex() if p.type == "string" else v.removeprefix("0x")
        return f"{len(data) // 2:064x}" + data.ljust(-(-len(data) // 64) * 64, "0")
    return encode_word(p, v)


def encode_event(e: Event, values: dict[str, Any]) -> tuple[list[str], str]:
    """(topics, data) of a log; indexed values of dynamic types are given as their hash."""
    topics = [e.topic0] + ["0x" + (values[p.name].removeprefix("0x") if _hashed(p) else encode_word(p, values[p.name])) for p in e.indexed]
    return topics, "0x" + encode(e.plain, [values[p.name] for p in e.plain])


def encode_call(f: Function, values: Sequence[Any]) -> str:
    return f.selector + encode(f.params, values)


def decode(params: Sequence[Param], data: bytes) -> list[Any]:
    """Values of the types that Param.spark names."""
    out, at = [], 0
    for p in params:
        if p.dynamic:
            offset = int.from_bytes(_slice(data, at, 32), "big")
            out.append(_decode_one(p, data[offset:] if offset <= len(data) else _slice(data, offset, 1)))
        else:
            out.append(_decode_one(p, _slice(data, at, 32 * p.words)))
        at += 32 * p.words
    return out


def _slice(data: bytes, at: int, size: int) -> bytes:
    if at + size > len(data):
        raise ValueError(f"data ends at byte {len(data)}, {at + size} are needed")
    return data[at : at + size]


def _decode_one(p: Param, data: bytes) -> Any:
    if p.element:
        inner, length = p.element
        if length is None:
            length, data = int.from_bytes(_slice(data, 0, 32), "big"), data[32:]
            _slice(data, 0, length * 32 * inner.words)
        return decode([inner] * length, data)
    if p.type == "tuple":
        return dict(zip((c.name for c in p.components), decode(p.components, data), strict=True))
    if p.type in ("string", "bytes"):
        body = _slice(data, 32, int.from_bytes(_slice(data, 0, 32), "big"))
        return body.decode("utf-8", "replace") if p.type == "string" else "0x" + body.hex()
    word = _slice(data, 0, 32)
    if p.bits:
        signed = not p.type.startswith("u")
        number, kind = int.from_bytes(word, "big", signed=signed), p.spark
        if not -(1 << p.bits - 1) * signed <= number < 1 << p.bits - signed:
            raise ValueError(f"{number} isn't a value of {p.type}")
        return number if isinstance(kind, T.LongType) else Decimal(number) if isinstance(kind, T.DecimalType) else str(number)
    if p.type == "bool":
        return any(word)
    return "0x" + (word[12:] if p.type == "address" else word[: int(p.type[5:])]).hex()


def decode_call(f: Function, calldata: str) -> list[Any]:
    if not calldata.lower().startswith(f.selector):
        raise ValueError(f"not a call of {f.signature}")
    return decode(f.params, bytes.fromhex(calldata[10:]))


# --- columns ----------------------------------------------------------------------------------------------------------


def indexed_filter(e: Event, values: dict[str, Any], topics: str = "topics") -> Column:
    """Logs of the event whose indexed parameters have one of the given values; names and values in any case."""
    from ledgerloom.operators.filters import all_of

    wanted = {k.lower(): v if isinstance(v, (list, tuple)) else [v] for k, v in values.items()}
    terms = [F.get(topics, 0) == e.topic0]
    for i, p in enumerate(e.indexed, 1):
        if p.name.lower() in wanted:
            terms.append(F.get(topics, i).isin(["0x" + encode_word(p, v) for v in wanted[p.name.lower()]]))
    return all_of(terms)


def is_event(e: Event, topics: str = "topics") -> Column:
    """First topic and number of topics fit."""
    return (F.get(topics, 0) == e.topic0) & (F.size(topics) == 1 + len(e.indexed))


def word_column(p: Param, word: Column) -> Column:
    """A static word (64 hex digits) as a value, with Spark expressions."""
    if p.type == "address":
        return F.concat(F.lit("0x"), F.lower(F.right(word, F.lit(40))))
    if p.type == "bool":
        return word != "0" * 64
    if p.bits:
        return _number(word, p.spark, not p.type.startswith("u"))
    return F.concat(F.lit("0x"), F.lower(F.left(word, F.lit(2 * int(p.type[5:])))))


def _number(word: Column, kind: T.DataType, signed: bool) -> Column:
    # conv() is limited to 64 bits, so the number is put together from parts of 13 hex digits and fewer
    limbs = [F.conv(F.substring(word, a, n), 16, 10).cast("decimal(38,0)") for a, n in ((52, 13), (39, 13), (26, 13), (13, 13), (1, 12))]
    if isinstance(kind, T.StringType):
        return _wide(word, limbs, signed)
    top = F.conv(F.substring(word, 35, 4), 16, 10).cast("decimal(38,0)")
    number = limbs[0] + limbs[1] * F.lit(Decimal(1 << 52)) + top * F.lit(Decimal(1 << 104))
    if signed:
        number = F.when(F.left(word, F.lit(1)) >= "8", number - F.lit(Decimal(1 << 120))).otherwise(number)
    return number.cast(kind)


def _wide(word: Column, limbs: list[Column], signed: bool) -> Column:
    """The decimal text of 256 bits: four digits to base 10**20, each the sum of the limbs' shares and what is carried."""
    negative = F.left(word, F.lit(1)) >= "8" if signed else F.lit(False)
    top = [(1 << 52) - 1] * 4 + [(1 << 48) - 1]
    parts = [F.when(negative, F.lit(Decimal(m)) - x).otherwise(x).cast("decimal(16,0)") for m, x in zip(top, limbs, strict=True)] if signed else [x.cast("decimal(16,0)") for x in limbs]
    base = 10**20
    sums = []
    for k in range(4):
        shares = [parts[i] * F.lit(Decimal((1 << 52 * i) // base**k % base)) for i in range(5) if (1 << 52 * i) // base**k % base]
        if k == 0 and signed:  # the two's complement is one more than the complement of the bits
            shares.append(F.when(negative, F.lit(Decimal(1))).otherwise(F.lit(Decimal(0))))
        total = shares[0].cast("decimal(38,0)")
        for share in shares[1:]:
            total = (total + share).cast("decimal(38,0)")
        sums.append(total)
    carried = F.array(*sums)
    step = lambda acc, x: _carry(acc, x, base)
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("decimal(38,0)").alias("carry"))
    digits = F.aggregate(carried, start, step, lambda acc: F.regexp_replace(F.concat(acc["carry"].cast("string"), acc["text"]), "^0+(?=.)", ""))
    # most numbers need no more than 120 bits
    third = F.conv(F.substring(word, 35, 4), 16, 10).cast("decimal(38,0)")

    def short(low: Column, middle: Column, high: Column, more: int) -> Column:
        return (low + middle * F.lit(Decimal(1 << 52)) + high * F.lit(Decimal(1 << 104)) + F.lit(Decimal(more))).cast("decimal(38,0)").cast("string")

    upper = F.lower(F.left(word, F.lit(34)))
    text = F.when(upper == "0" * 34, short(limbs[0], limbs[1], third, 0))
    if signed:
        text = text.when(upper == "f" * 34, F.concat(F.lit("-"), short(parts[0], parts[1], F.lit(Decimal((1 << 16) - 1)) - third, 1)))
        text = text.when(negative, F.concat(F.lit("-"), digits))
    return text.otherwise(digits)


def _carry(acc: Column, x: Column, base: int) -> Column:
    total = (acc["carry"] + x).cast("decimal(38,0)")
    digit = (total % F.lit(Decimal(base))).cast("decimal(38,0)")
    high = ((total - digit) / F.lit(Decimal(base))).cast("decimal(38,0)")
    return F.struct(F.concat(F.lpad(digit.cast("string"), 20, "0"), acc["text"]).alias("text"), high.alias("carry"))


def _static(e: Event) -> bool:
    return all(not _hashed(p) for p in e.plain)


def event_column(e: Event, topics: str = "topics", data: str = "data", on_error: str = "raise") -> Column:
    """The decoded parameters of a log of this event as a struct; null where it can't be decoded and on_error is `null`."""
    if _static(e):
        topic = lambda i: F.substring(F.get(topics, i), 3, 64)
        parts = {p.name: (F.get(topics, i) if _hashed(p) else word_column(p, topic(i))) for i, p in enumerate(e.indexed, 1)}
        parts |= {p.name: word_column(p, F.substring(data, 3 + 64 * i, 64)) for i, p in enumerate(e.plain)}
        fields = F.struct(*[parts[p.name].alias(p.name) for p in e.params])
        whole = F.length(data) >= 2 + 64 * len(e.plain)
        if on_error == "null":
            digits = F.regexp_like(F.substring(data, 3, 64 * len(e.plain)), F.lit("^[0-9a-fA-F]*$")) & (F.size(topics) > len(e.indexed))
            return F.when(whole & digits, fields)
        return F.when(F.assert_true(whole, F.lit(f"data too short for {e.signature}")).isNull(), fields)
    data = F.col(data)
    enough = F.size(topics) > len(e.indexed)
    first = {p.name: (F.get(topics, i) if _hashed(p) else word_column(p, F.substring(F.get(topics, i), 3, 64))) for i, p in enumerate(e.indexed, 1)}
    return _decoded(e, data, 2, enough, first, on_error)


def _decoded(e: Event, data: Column, skip: int, fits: Column, known: dict[str, Column], on_error: str) -> Column:
    """The parameters as a struct: those that are known already, and those that lie in the data behind `skip` characters of 0x hex."""

    def of(held: list[Column]) -> Column:
        (raw,) = held
        heads = [sum(p.words for p in e.plain[:k]) for k in range(len(e.plain))]
        zero = F.lit(0).cast("bigint")
        valid = _all([fits, raw.isNotNull(), *[_fits(p, raw, zero, F.lit(32 * at).cast("bigint")) for p, at in zip(e.plain, heads, strict=True)]])
        values = known | {p.name: _value(p, raw, zero, F.lit(32 * at).cast("bigint")) for p, at in zip(e.plain, heads, strict=True)}
        fields = F.struct(*[values[p.name].alias(p.name) for p in e.params])
        if on_error == "null":
            return F.when(valid, fields)
        return F.when(F.assert_true(valid, F.lit(f"data ends too early or isn't laid out as {e.signature}")).isNull(), fields)

    even = F.octet_length(data) % 2 == 0
    return bound_once([F.when(even, F.unhex(F.substring(data, skip + 1, 1 << 30)))], of)


def _all(terms: Sequence[Column]) -> Column:
    """Each term only where those before hold; null counts as false."""
    out = F.lit(True)
    for term in reversed(terms):
        out = F.when(term, out).otherwise(F.lit(False))
    return out


def _word(raw: Column, at: Column) -> Column:
    return F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(32)))


def _length(raw: Column, at: Column) -> Column:
    """The word as an offset or a length; null beyond 60 bits."""
    word = _word(raw, at)
    return F.when(F.left(word, F.lit(49)) == "0" * 49, F.conv(F.right(word, F.lit(15)), 16, 10).cast("bigint"))


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _tail(p: Param, raw: Column, base: Column, at: Column, of: Callable[[Column], Column]) -> Column:
    """of(place of the value): where its head says, counted from the head's tuple."""
    return bound_once([base + _length(raw, at)], lambda held: of(held[0]))


def _parts(p: Param) -> list[tuple[Param, int]]:
    """Components of a tuple or of an array of fixed length, with the places of their heads."""
    inner = [p.element[0]] * p.element[1] if p.element else list(p.components)
    return [(c, 32 * sum(x.words for x in inner[:k])) for k, c in enumerate(inner)]


def _leaves(p: Param) -> list[tuple[Param, int]]:
    """The words of a static value with their places."""
    if not p.element and p.type != "tuple":
        return [(p, 0)]
    return [(leaf, k + more) for c, k in _parts(p) for leaf, more in _leaves(c)]


def _in_range(p: Param, word: Column) -> Column:
    """Whether the number in a word needs no more bits than its type has."""
    n = 64 - p.bits // 4
    top, sign = F.lower(F.left(word, F.lit(n))), F.substring(word, n + 1, 1)
    if p.type.startswith("u"):
        return top == "0" * n
    return (top == "0" * n) & (sign < "8") | (top == "f" * n) & (sign >= "8")


def _fits(p: Param, raw: Column, base: Column, at: Column) -> Column:
    """Whether the data hold all of a value, so that reading it ends within them."""
    size = F.octet_length(raw).cast("bigint")
    if not p.dynamic:
        return _all([at + 32 * p.words <= size, *[_in_range(c, _word(raw, at + k)) for c, k in _leaves(p) if c.bits and c.bits < 256]])

    def tail(place: Column) -> Column:
        if p.element and p.element[1] is not None or p.type == "tuple":
            return _all([place <= size, *[_fits(c, raw, place, place + k) for c, k in _parts(p)]])
        inner = p.element[0] if p.element else None
        n = _length(raw, place)
        room = [place + 32 <= size, n <= size, place + 32 + n * (32 * inner.words if inner else 1) <= size]
        if inner and (inner.dynamic or any(c.bits and c.bits < 256 for c, _ in _leaves(inner))):
            room.append(F.forall(_indices(n), lambda i: _fits(inner, raw, place + 32, place + 32 + i * (32 * inner.words))))
        return _all(room)

    return _all([at + 32 <= size, _tail(p, raw, base, at, tail)])


def _value(p: Param, raw: Column, base: Column, at: Column) -> Column:
    """The value whose head is at a byte, of a tuple that starts at byte `base`."""
    if p.dynamic:
        return _tail(p, raw, base, at, lambda place: _at(p, raw, place))
    return _at(p, raw, at) if p.element or p.type == "tuple" else word_column(p, _word(raw, at))


def _at(p: Param, raw: Column, place: Column) -> Column:
    """A compound or dynamic value at its own place."""
    if p.type in ("string", "bytes"):
        body = F.substring(raw, (place + 33).cast("int"), _length(raw, place).cast("int"))
        return F.make_valid_utf8(body.cast("string")) if p.type == "string" else F.concat(F.lit("0x"), F.lower(F.hex(body)))
    if p.element and p.element[1] is None:
        inner = p.element[0]
        return F.transform(_indices(_length(raw, place)), lambda i: _value(inner, raw, place + 32, place + 32 + i * (32 * inner.words)))
    parts = [_value(c, raw, place, place + k) for c, k in _parts(p)]
    if p.element:
        return F.array(*parts).cast(p.spark)
    return F.struct(*[x.alias(c.name) for x, c in zip(parts, p.components, strict=True)])


def call_column(f: Function, data: str = "input", on_error: str = "raise") -> Column:
    """The arguments of a call as a struct, from calldata with the function's selector; null for other calls."""
    arguments = Event(f.name, tuple(Param(p.name, p.type, False, p.components) for p in f.params))
    if not _static(arguments):
        text = F.col(data)
        found = _decoded(arguments, text, 10, F.lit(True), {}, on_error)
        return F.when(F.coalesce(F.lower(F.left(text, F.lit(10))) == f.selector, F.lit(False)), found)
    parts = [word_column(p, F.substring(data, 11 + 64 * i, 64)).alias(p.name) for i, p in enumerate(arguments.params)]
    whole = F.length(data) >= 10 + 64 * len(parts)
    own = F.coalesce(F.lower(F.left(F.col(data), F.lit(10))) == f.selector, F.lit(False))
    fits = whole if on_error == "null" else F.assert_true(whole | ~own, F.lit(f"data too short for {f.signature}")).isNull()
    return F.when(own & fits, F.struct(*parts))


def decode_events(logs: DataFrame, events: dict[str, Event], topics: str = "topics", data: str = "data", on_error: str = "raise") -> dict[str, DataFrame]:
    """A table of decoded logs for each name. A log goes to the first declared event that it fits.

    With on_error `null` logs that can't be decoded keep a null event; `decoded` and `decode_errors` tell them apart.
    """
    for topic0, names in shared_topics(events).items():
        warnings.warn(f"{', '.join(names)} share the topic {topic0}: only {names[0]} gets its logs", stacklevel=2)
    left = logs
    out = {}
    for name, e in events.items():
        out[name] = left.where(is_event(e, topics)).withColumn("event", event_column(e, topics, data, on_error))
        left = left.where(~F.coalesce(is_event(e, topics), F.lit(False)))
    return out


def shared_topics(events: dict[str, Event]) -> dict[str, list[str]]:
    """First topics that several declared events have, with their names."""
    by: dict[str, list[str]] = {}
    for name, e in events.items():
        by.setdefault(e.topic0, []).append(name)
    return {t: names for t, names in by.items() if len(names) > 1}


def decoded(table: DataFrame) -> DataFrame:
    """Without the logs that couldn't be decoded."""
    return table.where("event is not null")


def decode_errors(found: dict[str, DataFrame]) -> DataFrame:
    """(name, skipped): how many logs of each event couldn't be decoded."""
    parts = [t.agg(F.sum(F.col("event").isNull().cast("long")).alias("skipped")).select(F.lit(n).alias("name"), F.coalesce("skipped", F.lit(0).cast("long")).alias("skipped")) for n, t in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
