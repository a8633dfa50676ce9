"""Row numbers in a total order, without one task for all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.landing import landed


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the place, from 1, of each row in its group. Rows are dealt out by ranges and sorted, numbered inside each range, and moved by the counts of the
    ranges before; only these counts, one per range and group, meet in one task. Ties stand in any order, a null group is a group."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = landed(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    counts = at.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_of")) - F.col("_n")
    moved = counts.select("_group", "_of", (before - F.col("_first") + 1).alias("_shift"))
    joined = at.join(F.broadcast(moved), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
