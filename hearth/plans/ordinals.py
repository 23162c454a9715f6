"""Consecutive numbers for the rows of a DataFrame without pulling them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut_lineage

_ROW_BITS = 33            # monotonically_increasing_id: partition above, row within it below


def dense_ordinals(df: DataFrame, name: str) -> DataFrame:
    """``df`` plus ``name`` = 1..n in its order: the place in the input partition, offset by the sizes
    of the partitions before it (one row per partition meets in one place).

    The rows are checkpointed first, so a recomputation cannot renumber them.
    """
    tagged = cut_lineage(df.withColumn("__mono", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("__pid", F.shiftright("__mono", _ROW_BITS)).withColumn(
        "__pos", F.col("__mono").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1)
    sizes = tagged.groupBy("__pid").agg(F.max("__pos").alias("__n"))
    offsets = sizes.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    return (tagged.join(F.broadcast(offsets), "__pid")          # one row per input partition
                  .withColumn(name, F.col("__off") + F.col("__pos")).drop("__pid", "__mono", "__pos", "__off"))
