"""Errors with stable codes."""

from __future__ import annotations

#: Codes and what they mean (fixed values).
CODES = {
    "E0001": "the pipe has no id",
    "E0002": "a block range can't be read",
    "E0003": "instruction discriminators clash",
    "E1001": "a fork came and the sink can't resolve it",
    "E1002": "a fork came without canonical blocks",
    "E1003": "no common ancestor is known",
    "E1004": "the canonical chain ends below the cursor",
    "E2003": "rows of a distributed table can't be removed",
    "E2004": "the table collapses by another column",
    "E2005": "the table has no sign column",
    "E2104": "the table isn't tracked",
    "E2105": "the table has no primary key",
    "E2106": "tables depend on each other in a circle",
    "E2207": "a declared column is missing",
    "E2208": "a column has another type or mode",
    "E2209": "the table isn't declared",
    "E2212": "there are rows but no state",
    "E2301": "no table is declared",
    "E2302": "a table is declared twice",
    "E2303": "a table has no columns",
    "E2304": "the block column is missing",
    "E2305": "the block column isn't an integer",
    "E2307": "a column type isn't supported",
    "E2308": "the table isn't declared",
    "E2309": "the file exists already",
    "E2312": "a block number is missing or outside of its batch",
    "E2313": "a value doesn't fit its column",
    "E2315": "a nested column is empty or too deep",
    "E2316": "a file's range ends before it starts",
    "E2317": "a file straddles the cursor",
    "E2319": "two changes of a key in one block have no order",
    "E2320": "a file isn't Parquet with the declared columns",
}


class LoomError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {CODES[code]}" + (f" ({detail})" if detail else ""))
        self.code = code
