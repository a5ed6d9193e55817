"""What a sink needs before its first batch: SQL files, and the order of tables that refer to each other."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerloom.errors import LoomError

#: A statement: up to a semicolon outside of quotes.
_STATEMENT = re.compile(r"""(?:'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|[^;'"`])+""")


def run_sql_files(spark: SparkSession, folder: str) -> None:
    """Runs the statements of every .sql file of a folder on the driver's machine, by file name."""
    for path in sorted(Path(folder).glob("*.sql")):
        for statement in _STATEMENT.findall(path.read_text()):
            if statement.strip():
                spark.sql(statement)


def delete_order(references: Mapping[str, Sequence[str]]) -> list[str]:
    """Tables such that each comes before those that it refers to; references: table -> tables that it refers to."""
    after = TopologicalSorter({t: [] for t in references})
    for table, others in references.items():
        for other in others:
            after.add(other, table)
    try:
        return list(after.static_order())
    except CycleError as e:
        raise LoomError("E2106", " -> ".join(e.args[1])) from e
