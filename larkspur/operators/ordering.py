"""Positions in a global order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.storage import written


def with_position(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """df with each row's place, from 1, in the given order, which should leave no ties.

    A distributed sort numbers the rows of each of its partitions; what meets in one place is one row a partition.
    """
    numbered = written(df.orderBy(*order).withColumn("larkspur_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("larkspur_at", 33)
    counts = numbered.groupBy(part.alias("larkspur_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("larkspur_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("larkspur_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("larkspur_start"))
    rows = numbered.withColumn("larkspur_part", part).join(F.broadcast(starts), "larkspur_part")
    place = F.col("larkspur_start") + F.col("larkspur_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn(name, place).drop("larkspur_part", "larkspur_at", "larkspur_start")
