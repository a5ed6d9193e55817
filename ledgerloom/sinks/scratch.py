"""A place for tables that a query writes on its way."""

from __future__ import annotations

import contextvars
import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which all executors share; in local mode a temporary folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/ledgerloom-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder and all below it, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: The folder of the run that `folder` is called in.
_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of the run, or in the shared one outside of a run."""
    run = _run.get()
    return f"{run}/{name}-{uuid.uuid4().hex}" if run else scratch(spark, name)


def tidy(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query as a run with a folder of its own, which is deleted once its rows are written; these are all that stays."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        top, rows = scratch(spark, "run"), scratch(spark, "result")
        token = _run.set(top)
        try:
            found = query(spark, *args)
            found.write.parquet(rows)
        finally:
            _run.reset(token)
            remove(spark, top)
        return spark.read.schema(found.schema).parquet(rows)

    return run
