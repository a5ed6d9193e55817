"""The state of a pipe: cursor, finality floor, rollback chain. Pure functions over a few blocks, for the driver.

Blocks are ordered by number; a fork replaces a suffix of the chain. Rows above the floor may be taken back, rows at or
below it never are. None of this is event time, so Spark's watermarks don't apply.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from itertools import accumulate

from ledgerloom.errors import LoomError


@dataclass(frozen=True)
class Cursor:
    number: int
    hash: str | None = None
    timestamp: int | None = None

    def same(self, other: Cursor) -> bool:
        """Equal numbers, and equal hashes where both are known."""
        return self.number == other.number and (self.hash is None or other.hash is None or self.hash == other.hash)


@dataclass(frozen=True)
class Record:
    """One saved state: the chain above the floor, and the floor."""

    chain: tuple[Cursor, ...] = ()
    finalized: Cursor | None = None


@dataclass(frozen=True)
class PipeState:
    """applied: the number of the last response that the state holds, for those that are read again after a crash."""

    cursor: Cursor | None = None
    finalized: Cursor | None = None
    chain: tuple[Cursor, ...] = ()
    applied: int = 0

    def resume_from(self, start: int = 0) -> int:
        return start if self.cursor is None else self.cursor.number + 1

    def advance(self, blocks: Sequence[Cursor], finalized: Cursor | None) -> PipeState:
        """After a batch (without blocks: a new head alone). The floor never falls; a missing head keeps it."""
        numbers = [b.number for b in blocks]
        if any(a >= b for a, b in zip(numbers, numbers[1:], strict=False)) or (numbers and self.cursor and numbers[0] <= self.cursor.number):
            raise ValueError(f"blocks out of order at {numbers}")
        floor = clamp(self.finalized, finalized)
        chain = tuple(b for b in (*self.chain, *blocks) if floor is not None and b.number > floor.number)
        return PipeState(blocks[-1] if blocks else self.cursor, floor, chain, self.applied)

    def rolled_back(self, ancestor: Cursor) -> PipeState:
        return replace(self, cursor=ancestor, chain=tuple(b for b in self.chain if b.number <= ancestor.number))


def after_response(state: PipeState, number: int | None) -> PipeState:
    return state if number is None else replace(state, applied=max(number, state.applied))


def clamp(floor: Cursor | None, incoming: Cursor | None) -> Cursor | None:
    """The higher of both; of equals the one that is known."""
    if incoming is None or (floor is not None and incoming.number <= floor.number):
        return floor
    return incoming


def highest(heads: Iterable[Cursor]) -> Cursor | None:
    out = None
    for head in heads:
        if out is None or head.number > out.number:
            out = head
    return out


def resolve_fork(records: Iterable[Record], canonical: Sequence[Cursor]) -> Cursor | None:
    """The block to go back to: the newest stored one that is canonical. None if there is none.

    Records come newest first. Canonical blocks count below the last stored block that was looked at, through all records.
    If none is left for a stored block, the canonical chain is known too little: that stored block is returned, for a
    further fork signal to tell more, unless it is below the floor. If a record's blocks leave one canonical block and it is
    the record's floor, that is returned.
    """
    if not canonical:
        raise LoomError("E1002")
    lowest: dict[str | None, int] = {}
    for b in canonical:
        lowest[b.hash] = min(b.number, lowest.get(b.hash, b.number))
    stored, floors, ends = [], [], []
    for record in records:
        stored += sorted(record.chain, key=lambda b: -b.number)
        floors += [record.finalized] * len(record.chain)
        ends += [len(stored)] if record.chain else []
    below = [float("inf"), *accumulate((b.number for b in stored), min)]  # canonical blocks count below this number, before each stored block
    outcomes: dict[float, Cursor | None] = {}  # by the place at which each is met
    if (k := next((k for k, b in enumerate(stored) if lowest.get(b.hash, float("inf")) < below[k]), None)) is not None:
        outcomes[k] = stored[k]
    if (k := next((k for k in range(len(stored)) if below[k] <= min(lowest.values())), None)) is not None:
        outcomes[k] = None if floors[k] is not None and stored[k].number < floors[k].number else stored[k]
    for end in ends:
        if (floor := floors[end - 1]) is not None and [b.hash for b in canonical if b.number < below[end]] == [floor.hash]:
            outcomes.setdefault(end - 0.5, floor)
    return outcomes[min(outcomes)] if outcomes else None


def ancestor(records: Iterable[Record], canonical: Sequence[Cursor], cursor: Cursor | None) -> Cursor:
    """resolve_fork with coded errors. With a cursor the canonical blocks must reach it (rows above them would survive)."""
    if not canonical:
        raise LoomError("E1002")
    if cursor is not None and max(b.number for b in canonical) < cursor.number:
        raise LoomError("E1004")
    found = resolve_fork(records, canonical)
    if found is None:
        raise LoomError("E1003")
    return found
