"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, written as Parquet and reread; all but the last return the
columns of documents, in their order. Very long texts are handled whole, in one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, line_dedup, near_dedup, packing, quality_model
from larkspur.llm.queries import TOKENIZER, table
from larkspur.llm.storage import cut, free_name, named

#: Least quality score of a document that stays.
MIN_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels of some of them, doesn't reject.

    A null or empty text is scored as a text without words, and stays or goes by that; repeated rows stay or go alike. Columns of any names
    come back as they were. An empty table gives an empty result; without labels of both kinds all texts get the same score.
    """
    fair, score = ~quality_model.held_out(), free_name(docs, "larkspur_score")
    model = quality_model.train(docs.where(fair), table(spark, sf_dir, "labels").where(fair))
    return quality_model.score_texts(docs, model, score_column=score).where(F.col(score) >= MIN_QUALITY).select(*named(docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars is counted anew where lines went.

    A null source is one of its own, null texts stay null, repeated rows are pages of their own, and a text all of whose lines go stays as an
    empty one. Columns of any names come back as they were. An empty table gives an empty result.
    """
    return line_dedup.without_boilerplate(docs, length_column="n_chars" if "n_chars" in docs.columns else None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that near duplicates link.

    Rows without an id, and rows repeated with their id, are linked by their texts as all others, and one row of a group stays. Null, empty and white
    texts are linked with nothing and stay. Columns of any names come back as they were. An empty table gives an empty result.
    """
    return near_dedup.drop_near_duplicates(docs, shingle_words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    Null and empty texts stay, repeated rows stay or go alike, and items without an id count. Columns of any names come back as they were. An
    empty table gives an empty result, and an empty benchmark drops nothing.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 ids.

    A null or empty text is the end id alone; rows that repeat, share an id or have none are packed each on its own; other columns are not
    used. An empty table gives an empty result.
    """
    return packing.pack_documents(docs, TOKENIZER, capacity=2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
#: A trained classifier isn't SQL; tests hold every stage, and run() as a whole, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
