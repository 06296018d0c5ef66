"""Tables and folders that the driver and all executors share."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.storage import new_path
from larkspur.sources.storage import written as cut

__all__ = ["bounded", "broadcast_if_small", "cut", "free_name", "give_back", "join_with_hot", "named", "new_path", "open_fs", "own_names", "plain_names", "tasks", "trimmed"]


def open_fs(uri: str, mode: str):
    """A file in the shared folder, opened for random reads ("r") or for writing ("w"); "mkdir" makes a folder."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "mkdir":
        return store.create_dir(path, recursive=True)
    return store.open_input_file(path) if mode == "r" else store.open_output_stream(path, compression=None)


#: Bytes of an Arrow batch that the JVM hands to Python, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df as it is; from now on its session hands at most BATCH_BYTES at once to Python, so that long texts don't add up.

    A smaller bound that the session has already stays.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.sub("[^0-9]", "", spark.conf.get(key, "67108864b"))
    if int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns to the system what this process holds of memory that is no longer used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
    if trim:
        trim(0)


def trimmed(run):
    """run, a function over Arrow batches; when it is done, its worker gives memory that it no longer uses back.

    Workers outlive their tasks, and what one stage took would else add to what the next one takes.
    """

    def with_end(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return with_end


#: Most tasks that one step is dealt to.
MOST_TASKS = 100_000


def tasks(amount: int, of: int) -> int:
    """How many tasks share an amount of which each takes about `of`.

    For steps whose rows are small but stand for much work, such as paths of files: without a number of its own,
    the engine would merge partitions by the bytes of the rows alone, at last into one.
    """
    return min(MOST_TASKS, max(1, -(-amount // of)))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; otherwise as it is, for a shuffled join.

    Meant for tables already written with cut(), where counting costs a read of the footers.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key that has more than this share of the rows is a hot one. There can be no more of them than its inverse.
HOT_KEYS = 10_000


def join_with_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right on keys, without putting all rows of a hot key into one task.

    right has one narrow row for each key, and says in its column `rows` how many rows of left have the key; `total` is the
    number of rows of left, and `how` is inner or left. Rows of right for hot keys, at most HOT_KEYS by their definition, are
    broadcast; the others are met in a shuffle, in which no key has more than total / HOT_KEYS rows. Keys must not be null.
    """
    bound = total // HOT_KEYS
    hot, cold = right.where(F.col(rows) > bound).drop(rows), right.where(F.col(rows) <= bound).drop(rows)
    met = left.join(F.broadcast(hot), keys)
    return met.unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, in which a dot leads to no field."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns in0, in1 and so on, and which of them each column is: whatever the names are, helper columns don't clash with them."""
    names = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def own_names(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The columns of plain_names(), and then those in more, by their own names."""
    return df.select(*names.values(), *more).toDF(*names, *more)
