"""Borsh layouts compiled to Spark expressions: a fold over the fields with a moving position, without a Python worker.

What has a fixed size is read at its place; behind a string, option, array or enum the next place is a variable of the expression. A value is
a struct (v, next): `next` is the byte behind it, null where it can't be decoded, and what ends beyond the data is found at the end, once.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import abi
from .base58 import ALPHABET
from .scalars import bound_once

SIZES = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "f64": 8, "u128": 16, "i128": 16, "bool": 1, "address": 32, "unit": 0}


def size(kind: Any) -> int | None:
    """Bytes of a value; None where they vary."""
    if isinstance(kind, str):
        return SIZES.get(kind)
    if kind[0] == "fixed":
        inner = size(kind[1])
        return None if inner is None else inner * kind[2]
    parts = [size(k) for k in kind[1].values()] if kind[0] == "struct" else [None]
    return None if None in parts else sum(parts)


def column(data_hex: Column, start: bytes, kind: Any, schema: T.DataType, on_error: str) -> Column:
    """The value behind the discriminator in 0x hex; null stays null. on_error `null`: what can't be decoded is null, too."""

    def of(held: list[Column]) -> Column:
        raw, found = held[0], held[0]
        own = F.lower(F.hex(F.substring(raw, 1, len(start)))) == start.hex()

        def checked(got: list[Column]) -> Column:
            (found,) = got
            fits = F.coalesce(own & (found.getField("next") <= F.octet_length(raw)), F.lit(False))
            if on_error != "null":
                fits = F.assert_true(fits | data_hex.isNull(), F.lit(f"data end too early or aren't laid out as {kind!r} behind 0x{start.hex()}")).isNull() & data_hex.isNotNull()
            return F.when(fits, found.getField("v"))

        return bound_once([read(kind, schema, found, F.lit(len(start)).cast("bigint"))], checked)

    even = F.octet_length(data_hex) % 2 == 0
    return bound_once([F.when(even, F.unhex(F.substring(data_hex, 3, 1 << 30)))], of)


def _result(value: Column, after: Column, kind: T.DataType) -> Column:
    return F.struct(value.cast(kind).alias("v"), after.cast("bigint").alias("next"))


def _bytes(raw: Column, at: Column, n: int | Column) -> Column:
    return F.substring(raw, (at + 1).cast("int"), F.lit(n) if isinstance(n, int) else n.cast("int"))


def _hex(raw: Column, at: Column, n: int) -> Column:
    """Hex digits of a little-endian number, the highest first."""
    return F.hex(F.concat(*[_bytes(raw, at + k, 1) for k in reversed(range(n))]))


def _unsigned(raw: Column, at: Column, n: int) -> Column:
    return F.conv(_hex(raw, at, n), 16, 10).cast("bigint" if n < 8 else "decimal(20,0)")


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def read(kind: Any, to: T.DataType, raw: Column, at: Column) -> Column:
    """(v, next) of the value at a byte."""
    if (n := size(kind)) is not None:
        return _result(_fixed(kind, to, raw, at), at + n, to)
    end = F.octet_length(raw).cast("bigint")
    if kind == "string":
        n = _unsigned(raw, at, 4)
        text = _bytes(raw, at + 4, n).cast("string")
        return F.when(at + 4 + n <= end, _result(text, F.when(F.is_valid_utf8(text), at + 4 + n), to)).otherwise(_nothing(to))
    name, inner = kind[0], kind[1]
    if name == "option":
        return F.when(_unsigned(raw, at, 1) == 0, _result(F.lit(None), at + 1, to)).otherwise(read(inner, to, raw, at + 1))
    if name == "struct":
        return _chain(list(inner.items()), to, raw, at, {})
    if name == "enum":
        out = F.when(F.lit(False), _nothing(to))
        for k, (case, part) in enumerate(inner.items()):
            value = bound_once([read(part, to["value"].dataType, raw, at + 1)], lambda r, case=case: _result(F.struct(F.lit(case).alias("kind"), r[0].getField("v").alias("value")), r[0].getField("next"), to))
            out = out.when(_unsigned(raw, at, 1) == k, value)
        return out.otherwise(_nothing(to))
    if name == "fixed":
        return _listed(inner, to, raw, at, F.lit(kind[2]).cast("bigint"))
    if name == "array":
        each = size(inner)
        n = _unsigned(raw, at, 4)
        room = F.when(at + 4 + n * (each or 1) <= end, n)  # an array of nothing has no more items than the data have bytes
        return bound_once([room], lambda held: F.when(held[0].isNotNull(), _listed(inner, to, raw, at + 4, held[0])).otherwise(_nothing(to)))
    raise ValueError(f"unknown type {kind!r}")


def _nothing(to: T.DataType) -> Column:
    return _result(F.lit(None), F.lit(None), to)


def _listed(inner: Any, to: T.ArrayType, raw: Column, at: Column, n: Column) -> Column:
    if (each := size(inner)) is not None:
        return _result(F.transform(_indices(n), lambda i: _fixed(inner, to.elementType, raw, at + i * each)), at + n * each, to)

    def step(acc: Column, _: Column) -> Column:
        more = lambda r: _result(F.concat(acc.getField("v"), F.array(r[0].getField("v"))), r[0].getField("next"), to)
        return bound_once([read(inner, to.elementType, raw, acc.getField("next"))], more)

    return F.aggregate(_indices(n), _result(F.array(), at, to), step)


def _chain(fields: list[tuple[str, Any]], to: T.StructType, raw: Column, at: Column, done: dict[str, Column]) -> Column:
    for k, (name, kind) in enumerate(fields):
        part = to[name].dataType
        if (n := size(kind)) is None:
            return bound_once([read(kind, part, raw, at)], lambda r: _chain(fields[k + 1 :], to, raw, r[0].getField("next"), done | {name: r[0].getField("v")}))
        done, at = done | {name: _fixed(kind, part, raw, at).cast(part)}, at + n
    return _result(F.struct(*[done[f.name].alias(f.name) for f in to.fields]), at, to)


def _fixed(kind: Any, to: T.DataType, raw: Column, at: Column) -> Column:
    """A value of fixed size."""
    if kind == "unit":
        return F.lit(None).cast(to)
    if kind == "bool":
        return _unsigned(raw, at, 1) != 0
    if kind == "address":
        return base58_of_32(_bytes(raw, at, 32))
    if kind in ("u128", "i128"):
        digits = _hex(raw, at, 16)
        sign = F.when(F.left(digits, F.lit(1)) >= "8", "F" * 32).otherwise("0" * 32) if kind == "i128" else F.lit("0" * 32)
        return abi.word_column(abi.Param("x", f"{'u' * (kind == 'u128')}int128"), F.concat(sign, digits))
    if kind == "f64":
        return _double(_hex(raw, at, 8))
    if isinstance(kind, str):
        n = SIZES[kind]
        number = _unsigned(raw, at, n)
        half, whole = (F.lit(Decimal(1 << k)).cast(_type(n)) for k in (8 * n - 1, 8 * n))
        return number if kind[0] == "u" else F.when(number >= half, number - whole).otherwise(number)
    if kind[0] == "fixed":
        each = size(kind[1])
        return F.array(*[_fixed(kind[1], to.elementType, raw, at + k * each) for k in range(kind[2])]).cast(to)
    parts, place = [], at
    for name, part in kind[1].items():
        parts.append(_fixed(part, to[name].dataType, raw, place).cast(to[name].dataType).alias(name))
        place = place + size(part)
    return F.struct(*parts)


def _type(n: int) -> str:
    return "bigint" if n < 8 else "decimal(20,0)"


def _double(digits: Column) -> Column:
    """The IEEE number of 16 hex digits: sign, exponent and mantissa; all steps are exact."""
    head = F.conv(F.left(digits, F.lit(3)), 16, 10).cast("bigint")
    mantissa = F.conv(F.right(digits, F.lit(13)), 16, 10).cast("bigint")
    sign, exponent = F.when(head >= 2048, -1.0).otherwise(1.0), head % 2048
    scaled = lambda m, e: m.cast("double") * F.pow(F.lit(2.0), e.cast("double"))
    finite = F.when(exponent == 0, scaled(mantissa, F.lit(-1074))).otherwise(scaled(mantissa + (1 << 52), exponent - 1075))
    return F.when(exponent < 2047, sign * finite).when(mantissa == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def base58_of_32(raw: Column) -> Column:
    """Base-58 text of 32 bytes: nine divisions of eight limbs by 58^5, five digits each."""
    digits, base = F.hex(raw), 58**5

    def divided(limbs: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("rest"))

        def step(acc: Column, x: Column) -> Column:
            now = lambda h: F.struct(F.concat(acc.getField("out"), F.array(_div(h[0], base))).alias("out"), (h[0] % base).alias("rest"))
            return bound_once([acc.getField("rest") * (1 << 32) + x], now)

        return F.aggregate(limbs, start, step)

    def text(rest: Column) -> Column:
        return F.concat(*[F.substring(F.lit(ALPHABET), (_div(rest, 58**k) % 58 + 1).cast("int"), F.lit(1)) for k in reversed(range(5))])

    limbs = F.array(*[F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(8)])
    start = F.struct(limbs.alias("limbs"), F.lit("").alias("text"))
    further: Callable = lambda acc, _: bound_once([divided(acc.getField("limbs"))], lambda q: F.struct(q[0].getField("out").alias("limbs"), F.concat(text(q[0].getField("rest")), acc.getField("text")).alias("text")))
    all_digits = F.aggregate(F.sequence(F.lit(1), F.lit(9)), start, further, lambda acc: F.regexp_replace(acc.getField("text"), "^1+", ""))
    zeros = F.length(F.regexp_extract(digits, "^((?:00)*)", 1)) / 2
    return F.concat(F.repeat(F.lit("1"), zeros.cast("int")), all_digits)


def _div(x: Column, by: int) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return F.call_function("div", x, F.lit(by).cast("bigint"))
