"""Which contracts can share a decoder: those with the same set of events over the same range."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from ledgerloom.functions.abi import Event

from .ranges import Range


@dataclass(frozen=True)
class Contract:
    name: str
    address: str
    events: tuple[Event, ...]
    range: Range = Range(0)

    @property
    def signatures(self) -> frozenset[str]:
        return frozenset(e.signature for e in self.events)


@dataclass(frozen=True)
class Group:
    """One decoder: its id, contracts, events and range."""

    id: str
    contracts: tuple[Contract, ...]
    events: tuple[Event, ...]
    range: Range


def group_contracts(contracts: Sequence[Contract], prefix: str = "custom") -> list[Group]:
    """One decoder for all contracts if all have the same events and the same range, else one for each.

    Contracts without events are left out. A decoder of one contract among several is named after it; names that are taken get a
    number.
    """
    listed = [c for c in contracts if c.events]
    if not listed:
        return []
    if len({(c.signatures, c.range) for c in listed}) == 1:
        return [Group(prefix, tuple(listed), listed[0].events, listed[0].range)]
    groups, taken = [], set()
    for c in listed:
        words = re.findall(r"[A-Za-z0-9]+", c.name)
        base = prefix + "".join(w[:1].upper() + w[1:] for w in words)
        name, n = base, 2
        while name in taken:
            name, n = f"{base}{n}", n + 1
        taken.add(name)
        groups.append(Group(name, (c,), c.events, c.range))
    return groups
