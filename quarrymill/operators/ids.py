"""Dense row numbers over distinct values without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrymill.plans.storage import materialize


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """(column, row): distinct non-null values numbered from 0 in ascending order.

    Values are sorted by range partitions, numbered inside each and shifted by the sizes of those before.
    """
    ranged = values.select(column).dropna().distinct().repartitionByRange(column).sortWithinPartitions(column)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "range-parts")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return ranged.withColumn("place", place).join(shifts, "part").select(column, (F.col("place") + F.col("shift")).alias("row"))
