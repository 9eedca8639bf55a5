"""Running totals over ordered values without ordering a group in one task.

Rows are dealt by ranges of (group, value), so one large group spreads over many partitions.
A total within each partition plus the totals of the partitions before it (one row for each
partition and group) is the total over the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def top_by(rows: DataFrame, order: list, n: int, *by: str) -> DataFrame:
    """The first ``n`` rows of each group (0: all), by repository where no other is named.

    A limit on row numbers is kept to n rows a task before the shuffle, so a large repository is no large task.
    """
    if not n:
        return rows
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*(by or ("repo_id",))).orderBy(*order)))
    return ranked.where(F.col("rank_") <= n).drop("rank_")


def running_totals(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """``rows`` (distinct by group and value) with ``below``: the weight of the group's smaller values; and ``total``."""
    spread = rows.repartitionByRange(group, value).withColumn("part", F.spark_partition_id())
    spread = cut(spread, "ranges")  # fixes which rows a partition holds
    here = Window.partitionBy("part", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("local", F.coalesce(F.sum(weight).over(here), F.lit(0)))
    parts = spread.groupBy(group, "part").agg(F.sum(weight).alias("w"))
    own = Window.partitionBy(group)
    parts = parts.select(group, "part", F.coalesce(F.sum("w").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("w").over(own).alias("total"))
    out = local.join(parts, [group, "part"])
    return out.withColumn("below", F.col("base") + F.col("local")).drop("part", "local", "base")
