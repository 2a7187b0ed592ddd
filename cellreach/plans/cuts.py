"""Lineage cuts for loops: reliable checkpoints in the folder that the session shares with its executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellreach-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_task: int, *keys: str, rows: int | None = None) -> DataFrame:
    """df, whose rows are counted if their number is not given, dealt to tasks of about per_task rows, by keys if any.

    For small rows that much work follows from, which Spark would put into few tasks by their size, and for tables that the session has too few shuffle partitions for.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if rows is None else rows) // per_task))
    return df.repartition(tasks, *keys)
