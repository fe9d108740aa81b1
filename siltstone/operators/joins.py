"""Joins and tasks of tables whose size Spark can't tell."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: So many rows that cost much each go to a task.
ROWS_A_TASK = 8_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys, before work that costs much for each: Spark cuts a table in tasks by its bytes, and a few megabytes of keys are one."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)), *keys)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right by sorting both.

    Spark takes the lines that a text is split into, and what is found in them, for as small as the table they
    come from. A join that it plans by that size sends them whole through the driver and to every executor.
    """
    return left.join(right.hint("merge"), on, how)
