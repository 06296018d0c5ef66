"""Join keys that nulls don't make hot, and tables that meet in tasks of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About how many rows, and bytes of their texts, one task takes of tables that meet by a key.
TASK_ROWS, TASK_BYTES = 250_000, 32 << 20


def spread(key: Column, by: Column) -> Column:
    """The key as text, or, where it is null, a text of its own that no key has, made of `by`: in a shuffled left join, rows without a key then don't meet in one task."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), F.coalesce(by.cast("string"), F.lit(""))))


def _tasks_of(df: DataFrame) -> float:
    texts = [F.coalesce(F.octet_length(F.col("`" + f.name.replace("`", "``") + "`")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return max(rows / TASK_ROWS, size / TASK_BYTES)


def dealt(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """The tables, each given with its key, dealt by their keys to so many tasks that each takes about TASK_ROWS rows and TASK_BYTES of texts in all.

    The engine's own number of partitions doesn't grow with the tables, and a task that sorts holds all that it takes. Joins, windows and groups by these keys need
    no further shuffle. The tables are counted for it, in a pass of their own; those that fit into one task stay as they are.
    """
    n = math.ceil(sum(_tasks_of(df) for df, _ in tables))
    if n < 2:
        return [df for df, _ in tables]
    n = max(n, tables[0][0].sparkSession.sparkContext.defaultParallelism)
    return [df.repartition(n, key) for df, key in tables]
