"""Keccak-256 (the padding of the original submission, not SHA-3's), for event topics and selectors on the driver."""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """From the linear feedback register x^8 + x^6 + x^5 + x^4 + 1."""
    register, out = 1, []
    for _ in range(24):
        constant = 0
        for j in range(7):
            if register & 1:
                constant |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        out.append(constant)
    return out


_CONSTANTS = _round_constants()


def _turn(x: int, n: int) -> int:
    n %= 64
    return (x << n | x >> (64 - n)) & _MASK if n else x


def _permute(lanes: list[list[int]]) -> None:
    for constant in _CONSTANTS:
        parity = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
        for x in range(5):
            d = parity[x - 1] ^ _turn(parity[(x + 1) % 5], 1)
            for y in range(5):
                lanes[x][y] ^= d
        x, y, moved = 1, 0, lanes[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            lanes[x][y], moved = _turn(moved, (t + 1) * (t + 2) // 2), lanes[x][y]
        for y in range(5):
            row = [lanes[x][y] for x in range(5)]
            for x in range(5):
                lanes[x][y] = row[x] ^ (~row[(x + 1) % 5] & _MASK & row[(x + 2) % 5])
        lanes[0][0] ^= constant


def keccak256(data: bytes) -> bytes:
    rate = 136
    padded = bytearray(data + b"\x01" + bytes(-(len(data) + 1) % rate))
    padded[-1] |= 0x80
    lanes = [[0] * 5 for _ in range(5)]
    for k in range(0, len(padded), rate):
        for i in range(rate // 8):
            lanes[i % 5][i // 5] ^= int.from_bytes(padded[k + 8 * i : k + 8 * i + 8], "little")
        _permute(lanes)
    return b"".join(lanes[i % 5][i // 5].to_bytes(8, "little") for i in range(4))
