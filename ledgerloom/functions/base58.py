"""Base-58 texts as Spark expressions: conversion by limbs, and prefixes of the data as intervals of the text.

Texts of one length sort like their numbers, as the alphabet is in the order of its codes. The numbers whose bytes begin with a prefix
are one interval for each number of bytes, so of each text length at most one interval of texts begins with it: nothing is decoded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bound_once

ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_DIGIT = {c: i for i, c in enumerate(ALPHABET)}
#: Texts up to so many characters are compared with intervals, by so many first characters.
LONGEST, HEAD = 512, 16


def decode(text: str) -> bytes:
    number = reduce(lambda n, c: n * 58 + _DIGIT[c], text, 0)
    zeros = len(text) - len(text.lstrip("1"))
    return bytes(zeros) + number.to_bytes((number.bit_length() + 7) // 8, "big")


def encode(data: bytes) -> str:
    zeros = len(data) - len(data.lstrip(b"\0"))
    return "1" * zeros + _digits(int.from_bytes(data, "big"))


def _digits(number: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 58)
        out = ALPHABET[digit] + out
    return out


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def _rebased(digits: Column, base: int, to: int) -> Column:
    """Digits (the highest first) as digits of another base, the lowest first; base times `to` is below 2^62."""

    def carried(limbs: Column, digit: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), digit.alias("carry"))

        def step(acc: Column, x: Column) -> Column:
            return bound_once([x * base + acc.getField("carry")], lambda h: F.struct(F.concat(acc.getField("out"), F.array(h[0] % to)).alias("out"), _div(h[0], to).alias("carry")))

        # what is carried out is less than the base, so two more limbs hold it
        top = lambda c: F.when(c >= to, F.array(c % to, _div(c, to))).when(c > 0, F.array(c)).otherwise(F.array().cast("array<bigint>"))
        last = lambda acc: F.concat(acc.getField("out"), top(acc.getField("carry")))
        return F.aggregate(limbs, start, step, last)

    return F.aggregate(digits, F.array().cast("array<bigint>"), carried)


def _pieces(text: Column, width: int, fill: str) -> Column:
    """The text, filled at its start, in pieces of one width; none for an empty text."""
    n = F.ceil(F.length(text) / width)
    full = F.lpad(text, (n * width).cast("int"), F.lit(fill))
    places = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(places, lambda i: F.substring(full, (i * width + 1).cast("int"), F.lit(width)))


def is_base58(text: Column) -> Column:
    return text.rlike(f"\\A[{ALPHABET}]*\\z")


def to_hex(text: Column | str) -> Column:
    """0x-prefixed hex of base-58 text (a column or its name); null for null or what isn't base 58."""
    text = F.col(text) if isinstance(text, str) else text
    digit = lambda piece, k: F.instr(F.lit(ALPHABET), F.substring(piece, k + 1, 1)).cast("bigint") - 1
    number = lambda piece: reduce(lambda n, k: n * 58 + digit(piece, k), range(1, 5), digit(piece, 0))
    limbs = _rebased(F.transform(_pieces(text, 5, "1"), number), 58**5, 1 << 32)
    found = F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), "^0+", "")
    even = lambda h: F.concat(F.lit("0x"), F.repeat(F.lit("00"), F.length(F.regexp_extract(text, "^1*", 0))), F.when(F.length(h[0]) % 2 == 1, "0").otherwise(""), h[0])
    return F.when(is_base58(text), bound_once([found], even))


def from_hex(data_hex: Column) -> Column:
    """Base-58 text of hex digits (an even number, without 0x)."""
    words = F.transform(_pieces(data_hex, 8, "0"), lambda w: F.conv(w, 16, 10).cast("bigint"))
    place = lambda x, k: F.substring(F.lit(ALPHABET), (_div(x, 58**k) % 58 + 1).cast("int"), F.lit(1))
    texts = F.transform(F.reverse(_rebased(words, 1 << 32, 58**5)), lambda x: F.concat(*[place(x, k) for k in reversed(range(5))]))
    zeros = F.length(F.regexp_extract(data_hex, "^(?:00)*", 0)) / 2
    return F.concat(F.repeat(F.lit("1"), zeros.cast("int")), F.regexp_replace(F.array_join(texts, ""), "^1+", ""))


def _interval(rest: bytes, length: int) -> tuple[int, int] | None:
    """The lowest and the highest number of `length` digits whose bytes begin with `rest`, the first byte of which isn't 0."""
    first, low, high = int.from_bytes(rest, "big"), 58 ** (length - 1), 58**length - 1
    least = max(0, (low.bit_length() - first.bit_length()) // 8 - 1)
    for k in range(least, least + 4):
        a, b = max(low, first << (8 * k)), min(high, ((first + 1) << (8 * k)) - 1)
        if a <= b:
            return a, b
    return None


def _split(prefix: bytes) -> tuple[int, bytes]:
    rest = prefix.lstrip(b"\0")
    return len(prefix) - len(rest), rest


def starts_with(text: Column, prefix: bytes) -> Column:
    """Whether the data of base-58 text begin with a prefix, for texts of any length; null for null or what isn't base 58.

    A text is looked up by its length and compared by its first characters. Only the few that share them with an end of the interval,
    and those beyond `LONGEST`, are decoded.
    """
    zeros, rest = _split(prefix)
    if not rest:
        return F.when(is_base58(text), F.startswith(text, F.lit("1" * zeros)))
    lows, highs = [], []
    for length in range(1, LONGEST + 1):
        found = _interval(rest, length)
        cut = 58 ** max(0, length - HEAD)
        lows.append(_digits(found[0] // cut) if found else "")
        highs.append(_digits(found[1] // cut) if found else "")
    held = lambda listed, n: F.get(F.split(F.lit(",".join(listed)), ","), n - 1)
    own = F.startswith(text, F.lit("1" * zeros))

    def compared(bound: list[Column]) -> Column:
        (body,) = bound
        n, head = F.length(body), F.left(body, F.lit(HEAD))
        low, high = held(lows, n), held(highs, n)
        decoded = F.startswith(to_hex(body), F.lit("0x" + rest.hex()))
        inside = (low != "") & (head >= low) & (head <= high)
        edge = (n > HEAD) & ((head == low) | (head == high))
        return F.when(F.left(body, F.lit(1)) == "1", F.lit(False)).when(n == 0, F.lit(False)).when(n > LONGEST, decoded).when(inside & edge, decoded).otherwise(inside)

    return F.when(is_base58(text), own & bound_once([F.substring(text, zeros + 1, 1 << 30)], compared))


def one_of(text: Column, width: int, values: Sequence[str]) -> Column:
    """Whether the first `width` bytes of the data are one of the values (lower-case 0x hex); data of fewer bytes are meant by all of them."""
    terms = []
    for value in values:
        digits = value.removeprefix("0x")
        if not value.startswith("0x") or len(digits) % 2 or not set(digits) <= set("0123456789abcdef") or len(digits) > 2 * width:
            continue
        data = bytes.fromhex(digits)
        terms.append(starts_with(text, data) if len(data) == width else text == encode(data))
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def ranges(prefix: bytes, longest: int) -> list[tuple[str, str]]:
    """The intervals (low, high) of all texts of at most so many characters whose data begin with a prefix: sorted, without overlap."""
    zeros, rest = _split(prefix)
    if not rest:
        return [("1" * zeros, "1" * zeros + "z" * max(0, longest - zeros))]
    found = [i for n in range(1, longest - zeros + 1) if (i := _interval(rest, n))]
    out: list[tuple[str, str]] = []
    for low, high in sorted(("1" * zeros + _digits(a), "1" * zeros + _digits(b)) for a, b in found):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def pruning(column: Column, prefixes: Sequence[bytes], longest: int) -> Column:
    """What `starts_with` of any of the prefixes implies for a stored column, as plain comparisons that reach the statistics of the files.

    longest: the caller's promise that no text has more characters; use it beside the exact predicate, which it doesn't replace.
    """
    terms = [column.between(low, high) for prefix in prefixes for low, high in ranges(prefix, longest)]
    while len(terms) > 1:  # a balanced tree of ORs
        terms = [a | b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
    return terms[0] if terms else F.lit(False)
