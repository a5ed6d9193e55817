"""Small column functions: addresses, script kinds, amounts, text forms."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal
from hashlib import sha256
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Output script types and the kind that they are shown as (fixed values).
SCRIPT_KINDS = {
    "pubkey": "p2pk",
    "pubkeyhash": "P2PKH",
    "scripthash": "P2SH",
    "witness_v0_keyhash": "P2WPKH",
    "witness_v0_scripthash": "P2WSH",
    "witness_v1_taproot": "P2TR",
    "nulldata": "OP_RETURN",
    "multisig": "multisig",
}


def topic_address(topic: Column, prefix: str = "0x") -> Column:
    """The address in the last 20 bytes of a topic; prefix `41` gives the 21-byte form."""
    return F.concat(F.lit(prefix), F.lower(F.right(topic, F.lit(40))))


def script_kind(kind: Column) -> Column:
    out = F.lit("unknown")
    for name, value in SCRIPT_KINDS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def op_return_text(asm: Column) -> Column:
    """What an OP_RETURN script carries in its first push: text in double quotes if all bytes are printable ASCII, else 0x hex.

    Other scripts are returned as they are. Of an odd number of digits the last one is no byte.
    """
    payload = F.regexp_extract(asm, r"(?i)^OP_RETURN\s+([0-9a-f]+)", 1)
    whole = F.substring(payload, F.lit(1), F.length(payload) - F.length(payload) % 2)
    printable = F.regexp_like(whole, F.lit("^(?:[2-6][0-9a-fA-F]|7[0-9a-eA-E])*$"))
    text = F.concat(F.lit('"'), F.decode(F.unhex(whole), "US-ASCII"), F.lit('"'))
    return F.when(payload == "", asm).otherwise(F.when(printable, text).otherwise(F.concat(F.lit("0x"), payload)))


def scaled(amount: Column, decimals: Column) -> Column:
    """A token amount in units: amount / 10^decimals."""
    return amount.cast("double") / F.pow(F.lit(10.0), decimals)


def clamped(value: Column, digits: int = 38) -> Column:
    """At most the largest number of so many digits."""
    return F.least(value, F.lit(Decimal(10**digits - 1)))


def block_time(seconds: Column, unit: str = "s") -> Column:
    """A timestamp from raw header time in seconds (`s`) or milliseconds (`ms`)."""
    return F.timestamp_millis(seconds) if unit == "ms" else F.timestamp_seconds(seconds)


def signature_suffix(signature: Column) -> Column:
    """The first four hex digits of a signature's SHA-256."""
    return F.left(F.sha2(signature.cast("binary"), 256), F.lit(4))


def plain_number(text: Column) -> Column:
    """Digits without the commas and underscores between them."""
    return F.regexp_replace(text, "[,_]", "").cast("bigint")


def formatted(value: Column, digits: int = 2) -> Column:
    """Thousands with commas, at most so many decimals, none that are zero at the end."""
    text = F.format_number(value, digits)
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text


def formatted_block(value: Column) -> Column:
    """A block number with commas; text such as `latest` as it is."""
    return F.coalesce(formatted(value.try_cast("bigint"), 0), value.cast("string"))


def human_bytes(size: Column, largest: str = "TB") -> Column:
    """With two decimals in bytes, KB, MB, GB or TB, `largest` at most."""
    units = ("bytes", "KB", "MB", "GB", "TB")
    top = units.index(largest)
    shown = lambda k: F.format_string(f"%.2f {units[k]}", size / F.lit(2.0 ** (10 * k)))
    out = shown(top)
    for k in range(top - 1, -1, -1):
        out = F.when(size < 2.0 ** (10 * (k + 1)), shown(k)).otherwise(out)
    return out


def eta(seconds: Column) -> Column:
    """Days and hours, hours and minutes, or minutes and seconds; unknown while null, NaN or infinite."""
    part = lambda x: F.floor(x).cast("string")
    two = lambda big, small, u, v: F.concat(F.lit("ETA: "), part(big), F.lit(f"{u} "), part(small), F.lit(v))
    known = (
        F.when(seconds < 1, "IN SYNC")
        .when(seconds < 3600, two(seconds / 60, seconds % 60, "m", "s"))
        .when(seconds < 86400, two(seconds / 3600, seconds % 3600 / 60, "h", "m"))
        .otherwise(two(seconds / 86400, seconds % 86400 / 3600, "d", "h"))
    )
    unknown = seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf"))
    return F.when(unknown, "ETA: calculating...").otherwise(known)


def parameter_filter(event: Column, params: dict[str, Sequence[Any]]) -> Column:
    """Whether an event kept as JSON has the given values: any case, values of a parameter ORed, parameters ANDed."""
    out = F.lit(True)
    for name, values in params.items():
        out = out & F.lower(F.get_json_object(event, f"$.{name}")).isin([str(v).lower() for v in values])
    return out


def query_hash(query: dict[str, Any], positional: Sequence[str] = ("fromBlock", "toBlock", "parentBlockHash")) -> str:
    """SHA-256 of the query's JSON without where it starts and ends; keys count in their order."""
    return sha256(json.dumps({k: v for k, v in query.items() if k not in positional}, separators=(",", ":")).encode()).hexdigest()


def dump_json(value: Any) -> str:
    """JSON in which integers too large for a double are text of their digits with an `n`."""

    def plain(x: Any) -> Any:
        if isinstance(x, bool) or not isinstance(x, (int, dict, list, tuple)):
            return x
        if isinstance(x, int):
            return f"{x}n" if abs(x) > 2**53 - 1 else x
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x]

    return json.dumps(plain(value), separators=(",", ":"))


def load_json(text: str) -> Any:
    """The reverse; only digits alone are revived, so negative ones stay text."""

    def back(x: Any) -> Any:
        if isinstance(x, str) and x.endswith("n") and x[:-1].isascii() and x[:-1].isdigit():
            return int(x[:-1])
        if isinstance(x, dict):
            return {k: back(v) for k, v in x.items()}
        return [back(v) for v in x] if isinstance(x, list) else x

    return back(json.loads(text))


def packed(values: Any, keep: int = 10) -> Any:
    """A preview: arrays longer than `keep` as their first element and a note."""
    if isinstance(values, dict):
        return {k: packed(v, keep) for k, v in values.items()}
    if not isinstance(values, list):
        return values
    return [packed(values[0], keep), f"... {len(values) - 1} more ..."] if len(values) > keep else [packed(v, keep) for v in values]


def bound_once(values: Sequence[Column], body: Callable[[list[Column]], Column]) -> Column:
    """body(values), each value computed once a row though the body looks at it for every item: it is a variable of an enclosing function."""
    if not values:
        return body([])
    return F.get(F.transform(F.array(values[0]), lambda v: bound_once(values[1:], lambda rest: body([v, *rest]))), F.lit(0))
