"""The registered query of each corpus operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import licenses, line_dedup, oracles, passages, quality_model, toxicity, vector_codes, warc, whitening
from larkspur.llm.decontamination import find_contamination, hit_words
from larkspur.llm.near_dedup import near_duplicates
from larkspur.llm.packing import pack_documents
from larkspur.llm.quality_rules import PROFILE_WEIGHT, quality_rules
from larkspur.llm.token_files import read_token_files, write_token_files

#: The public vocabulary that queries 8 and 9 name.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on sets of two-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and distances from the language's distributions of all documents, to which all that pass the base rules add."""
    return quality_rules(table(spark, sf_dir, "documents"), profile_weight=PROFILE_WEIGHT).drop("class_distance", "word_distance")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document stands in the benchmark."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    n_hit = hit_words()
    names = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, those dropped as boilerplate of its source, and a digest of what is left."""
    rows = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.md5("text").alias("text_md5"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among all documents, and known licence notices among their lines."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, by a model of labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs.where(~quality_model.held_out()), table(spark, sf_dir, "labels").where(~quality_model.held_out()))
    rows = quality_model.score_texts(docs, model, columns=["doc_id"])
    return rows.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives, and what their records say."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, and what these say of each document."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), TOKENIZER))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, by a network learnt from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.where(~quality_model.held_out()), table(spark, sf_dir, "labels").where(~quality_model.held_out()))
    rows = quality_model.score_texts(docs, model, columns=["doc_id"])
    return rows.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as codes of eight parts, with what is lost."""
    rows, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("codebooks_sha256", F.lit(vector_codes.codebooks_digest(books)))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without what stands earlier in the corpus, by runs of 20 words."""
    rows = passages.without_repeats(table(spark, sf_dir, "documents"))
    n_removed = hit_words("removed")
    return rows.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first four principal components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_quality_rules,
        op3_decontamination,
        op4_line_dedup,
        op5_license_scan,
        op6_quality_classifier,
        op7_warc,
        op8_token_files,
        op9_best_fit_packing,
        op10_toxicity,
        op11_vector_codes,
        op12_repeated_passages,
        op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op1_near_duplicates": oracles.NEAR_DUPLICATES,
    "op2_quality_rules": oracles.QUALITY_RULES,
    "op3_decontamination": oracles.DECONTAMINATION,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_license_scan": licenses.oracle(),
    "op7_warc": warc.ORACLE,
    "op11_vector_codes": vector_codes.oracle(),
    "op12_repeated_passages": passages.ORACLE,
}
