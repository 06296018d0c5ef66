"""The labelled texts that the two classifiers learn from, and learning from them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.storage import cut, trimmed

#: Most bytes of text that are learnt from, besides the first text of each label.
SAMPLE_BYTES = 64 << 20


def labelled_texts(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, sample: int, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, float]:
    """(id, label (0 or 1), text and by (a hash of the id) of the texts to learn from, the share of label 1 among all labelled ids).

    At most `sample` ids of each label, those that hash lowest, are taken, and the whole text of each. Of a label's texts, in the
    order of these hashes, as many are taken as have sample_bytes / 2 bytes together, and one at least. Rows without an
    id, a text or a label of 0 or 1 are left out, and so are ids that are labelled both ways; an id labelled twice
    alike counts once, and of several texts of one id the least one counts. Other columns are not used.
    """
    name = lambda c: F.col(f"`{c}`")
    given = labels.where(name(label_column).isin(0, 1) & name(id_column).isNotNull())
    marked = given.groupBy(name(id_column).cast("long").alias("id")).agg(F.min(name(label_column)).cast("int").alias("label"), F.max(name(label_column)).cast("int").alias("most"))
    marked = cut(marked.where("label = most").select("id", "label"), "labels")
    chosen = None
    for k in (0, 1):
        some = marked.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = some if chosen is None else chosen.unionAll(some)
    chosen = cut(chosen, "labelled")
    texts = docs.select(name(id_column).cast("long").alias("id"), name(text_column).cast("string").alias("text")).where("text is not null")
    # 2 * sample rows at most are broadcast, and as many texts are left
    found = cut(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("by", F.xxhash64("id")), "labelled-texts")
    so_far = Window.partitionBy("label").orderBy("by", "id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("id", "label", "by", F.octet_length("text").alias("bytes")).withColumns({"before": F.coalesce(F.sum("bytes").over(so_far), F.lit(0))})
    fits = sizes.where((F.col("before") == 0) | (F.col("before") + F.col("bytes") <= sample_bytes // 2)).select("id")
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    return found.join(F.broadcast(fits), "id", "left_semi").select("id", "label", "text", "by"), (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)


def learnt_in_one_task(rows: DataFrame, learn: Callable[[pa.Array, np.ndarray], Any]) -> Any:
    """What `learn` makes of the texts and labels of labelled_texts(), in the order of the hashes.

    One task holds the sample, so that the driver doesn't, and runs again elsewhere if its executor is lost. What comes back is the model alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("label", pa.int32()), ("text", pa.string())]))
        model = learn(table.column("text").cast(pa.large_string()).combine_chunks(), table.column("label").to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.coalesce(1).sortWithinPartitions("by", "id").select("label", "text").mapInArrow(trimmed(run), "model binary").first()
    if made is None:  # no partition at all
        return learn(pa.array([], pa.large_string()), np.zeros(0, np.int64))
    return pickle.loads(made["model"])
