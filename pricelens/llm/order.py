"""Rows numbered along a global order, and sums over all rows before each, without one task
that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import written

#: a table that is joined to all rows by a key is repeated this often, so that the rows of one
#: hot key meet in as many tasks
SALTS = 16


def placed(rows: DataFrame, order: list[Column], weight: str | None = None) -> DataFrame:
    """``rows`` with ``place``, the number of rows before each in ``order`` (from 0), and with
    ``before``, the sum of the bigint column ``weight`` over those rows, if one is named.

    Spark's range sort deals the rows; a task's rows are numbered by themselves, then shifted by
    what the tasks before hold, one row a task.  ``order`` must tell all rows apart or leave
    ties between rows that may change places.  The column names ``part``, ``row``, ``n``,
    ``w``, ``place`` and ``before`` must be free.  The result reads written tables only, so that a lost task
    finds the same numbers again."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(rows.orderBy(*order).select("*", F.spark_partition_id().alias("part"), row.alias("row")))
    sums = [F.count("*").alias("n")] + ([F.sum(weight).alias("w")] if weight else [])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    shift = rows.groupBy("part").agg(*sums).withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if weight:
        shift = shift.withColumn("w", F.coalesce(F.sum("w").over(earlier), F.lit(0)))
        within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("before", F.sum(weight).over(within) - F.col(weight))
    rows = rows.join(F.broadcast(shift), "part")  # as many rows as the sort has tasks
    rows = rows.withColumn("place", F.col("row") + F.col("n"))
    if weight:
        rows = rows.withColumn("before", F.col("before") + F.col("w"))
    return rows.drop("part", "row", "n", "w")


def joined_by_key(rows: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` and the columns of ``small``, one row a key, for each; a null key meets a null
    key.  The rows of a key are spread over SALTS tasks by the bigint column ``spread``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    other = small.withColumnRenamed(key, "other_key").withColumn("salt", salts)
    same = F.col(key).eqNullSafe(F.col("other_key")) & (F.col("salt") == F.pmod(F.col(spread), F.lit(SALTS)))
    return rows.join(other, same).drop("other_key", "salt")
