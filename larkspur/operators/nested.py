"""One-to-many nesting, and key/value tables as maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(parents: DataFrame, children: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """parents with an array of their children, in order; empty for none. One shuffle of the children by key."""
    columns = [order, *[c for c in children.columns if c not in (key, order)]]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(into))
    return parents.join(lists, key, "left").withColumn(into, F.coalesce(into, F.expr(f"array()").cast(lists.schema[into].dataType)))


def fold_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A settings table as one row with a map; meant for tables of few keys."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("settings"))


def setting(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The one value of a setting, or no row; the predicate reaches the scan."""
    return rows.where(F.col(key) == F.lit(name)).select(value).limit(1)
