"""Base58 and little-endian instruction data."""

from __future__ import annotations

import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import LoomError

from . import base58, borsh

base58_decode, base58_encode, base58_hex = base58.decode, base58.encode, base58.to_hex

#: Fixed-size numbers: struct codes and sizes.
_NUMBERS = {"u8": "<B", "u16": "<H", "u32": "<I", "u64": "<Q", "i8": "<b", "i16": "<h", "i32": "<i", "i64": "<q", "f64": "<d"}


class Borsh:
    """Reads single values, where no column is at hand, by type: a number's name, bool, string, address, unit, ("option", t), ("array", t),
    ("fixed", t, n), ("struct", {name: t}), ("enum", {name: t}). 128-bit numbers are decimal text."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"data ends at byte {len(self.data)}, {self.at + n} are needed")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, kind: Any) -> Any:
        if isinstance(kind, str) and kind in _NUMBERS:
            code = _NUMBERS[kind]
            return struct.unpack(code, self.take(struct.calcsize(code)))[0]
        if kind in ("u128", "i128"):
            return str(int.from_bytes(self.take(16), "little", signed=kind == "i128"))
        if kind == "bool":
            return self.take(1) != b"\0"
        if kind == "string":
            return self.take(self.read("u32")).decode()
        if kind == "address":
            return base58_encode(self.take(32))
        if kind == "unit":
            return None
        name, inner = kind[0], kind[1]
        if name == "option":
            return self.read(inner) if self.read("u8") else None
        if name == "array":
            return [self.read(inner) for _ in range(self.read("u32"))]
        if name == "fixed":
            return [self.read(inner) for _ in range(kind[2])]
        if name == "struct":
            return {k: self.read(t) for k, t in inner.items()}
        if name == "enum":
            case = list(inner)[self.read("u8")]
            return {"kind": case, "value": self.read(inner[case])}
        raise ValueError(f"unknown type {kind!r}")


def borsh_column(data_hex: Column, discriminator: str, fields: dict[str, Any], schema: str, on_error: str = "raise") -> Column:
    """The struct after the discriminator (0x hex) of instruction data, by Spark's own functions; other discriminators are errors, null stays null."""
    return borsh.column(data_hex, bytes.fromhex(discriminator.removeprefix("0x")), ("struct", fields), T.StructType.fromDDL(schema), on_error)


def event_column(message_hex: Column, discriminator: str, fields: dict[str, Any], schema: str, on_error: str = "raise") -> Column:
    """A program's event from the hex of its log message: laid out as instruction data, after a discriminator of 1, 2, 4 or 8 bytes."""
    if len(discriminator.removeprefix("0x")) // 2 not in (1, 2, 4, 8):
        raise LoomError("E0003", discriminator)
    return borsh_column(message_hex, discriminator, fields, schema, on_error)


def little_endian(data_hex: Column, at: int, size: int) -> Column:
    """The unsigned number of `size` bytes (8 at most) from byte `at` of 0x hex, by Spark's own functions: DECIMAL(20,0)."""
    digits = [F.substring(data_hex, 3 + 2 * (at + k), 2) for k in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("decimal(20,0)")


def check_discriminators(instructions: dict[str, str]) -> int:
    """The one width in bytes of a decoder's discriminators: distinct, and 1, 2, 4 or 8 bytes wide."""
    widths = {len(d.removeprefix("0x")) // 2 for d in instructions.values()}
    if len(widths) != 1 or not widths <= {1, 2, 4, 8}:
        raise LoomError("E0003", f"widths {sorted(widths)}")
    if len({d.lower() for d in instructions.values()}) != len(instructions):
        raise LoomError("E0003", "two instructions have one discriminator")
    return widths.pop()


def instruction_filter(programs: list[str], discriminator: str, program: str = "programId", data_hex: str = "data_hex") -> Column:
    return F.col(program).isin(programs) & F.startswith(F.lower(F.col(data_hex)), F.lit(discriminator.lower()))


def named_accounts(names: dict[str, int], accounts: str = "accounts") -> Column:
    """accounts[i] AS name; null past the end."""
    return F.struct(*[F.get(accounts, i).alias(n) for n, i in names.items()])


def account_selection(names: dict[str, int], wanted: dict[str, list[str]]) -> dict[str, list[str]]:
    """Request fields a0..a9 for accounts by name."""
    over = [n for n in wanted if names[n] > 9]
    if over:
        raise ValueError(f"accounts past the tenth can't be filtered: {over}")
    return {f"a{names[n]}": v for n, v in wanted.items()}


