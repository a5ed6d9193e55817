"""Inclusive block ranges: parsing, algebra, and merging of requests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from ledgerloom.errors import LoomError


@dataclass(frozen=True, order=True)
class Range:
    """Blocks low to high, both included; high None is open."""

    low: int
    high: int | None = None

    def __post_init__(self) -> None:
        if self.high is not None and self.high < self.low:
            raise LoomError("E0002", f"the range {self.low}-{self.high} ends before it starts")


OPEN = float("inf")


def _cuts(r: Range) -> tuple[int, float]:
    """The first block and the one after the last."""
    return r.low, OPEN if r.high is None else r.high + 1


def _spans(*cuts: tuple[float, float]) -> list[Range]:
    """The ranges between pairs of cuts, without empty ones."""
    return [Range(int(low), None if end == OPEN else int(end) - 1) for low, end in cuts if low < end]


def intersection(a: Range, b: Range) -> Range | None:
    (low, end), (other, last) = _cuts(a), _cuts(b)
    return next(iter(_spans((max(low, other), min(end, last)))), None)


def difference(a: Range, b: Range) -> list[Range]:
    """The parts of a outside b: none, one or two."""
    (low, end), (other, last) = _cuts(a), _cuts(b)
    return _spans((low, min(end, other)), (max(low, last), end))


def merge(requests: Iterable[tuple[Range, Any]]) -> list[tuple[Range, list[Any]]]:
    """Sorted disjoint segments with the requests that hold there. Ranges that only touch stay apart.

    Equal neighbours are kept as segments of their own where a range starts or ends between them.
    """
    given = list(requests)
    cuts = sorted({r.low for r, _ in given} | {r.high + 1 for r, _ in given if r.high is not None})
    segments = []
    for k, low in enumerate(cuts):
        high = cuts[k + 1] - 1 if k + 1 < len(cuts) else None
        held = [x for r, x in given if r.low <= low < _cuts(r)[1]]
        if held:
            segments.append((Range(low, high), held))
    return segments


def bound(ranges: Sequence[Range], limit: Range) -> list[Range]:
    """Each range clipped to the limit; empty ones are dropped. Without ranges, the limit itself."""
    if not ranges:
        return [limit]
    return [r for r in (intersection(x, limit) for x in ranges) if r is not None]


def next_queried(ranges: Sequence[Range], number: int) -> int | None:
    """The first block at or after `number` within any of the ranges."""
    reached = [max(number, r.low) for r in ranges if number < _cuts(r)[1]]
    return min(reached) if reached else None


def parse_number(text: str | int) -> int:
    """Digits with commas or underscores between them."""
    if isinstance(text, int):
        return text
    if not re.fullmatch(r"\s*\d[\d,_]*\s*", text):
        raise LoomError("E0002", f"{text!r} isn't a block number")
    return int(re.sub(r"[,_\s]", "", text))


def parse_time(text: str) -> int | None:
    """Seconds since the epoch of a text that starts with an ISO date (a date alone is midnight UTC), else None."""
    if not re.match(r"\d{4}-\d{2}-\d{2}", text):
        return None
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() // 1)


def parse(low: str | int | None, high: str | int | None, latest: Callable[[], int], block_at: Callable[[int], int | None], resume: int | None = None) -> Range:
    """A range from its written ends.

    low: a number, a date, `latest`, or nothing for 0. high: a number, a date, `+N` blocks after a numeric low
    (after another low it is read as the block N), or nothing for open. resume: the next block of a resumed run,
    which `latest` doesn't skip.
    """

    def at(text: str) -> int | None:
        seconds = parse_time(text)
        if seconds is None:
            return None
        found = block_at(seconds)
        if found is None:
            raise LoomError("E0002", f"no block at or after {text}")
        return found

    numeric = False
    if low in (None, "", 0, "0"):
        first = 0
    elif low == "latest":
        if isinstance(high, str) and parse_time(high) is not None:
            raise LoomError("E0002", "a date can't end a range that starts at the latest block")
        first = latest() if resume is None else min(latest(), resume)
    elif isinstance(low, str) and (found := at(low)) is not None:
        first = found
    else:
        first, numeric = parse_number(low), True
    if high in (None, "", 0, "0"):
        return Range(first)
    if isinstance(high, str) and high.startswith("+"):
        return Range(first, (first if numeric else 0) + parse_number(high[1:]))
    last = at(high) if isinstance(high, str) else None
    return Range(first, parse_number(high) if last is None else last)
