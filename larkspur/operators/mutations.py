"""Inserts, upserts, merges and deletes as functions of a base and a patch table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.strings import clean, is_url
from larkspur.operators.joins import dealt


def one_per_key(patch: DataFrame, keys: list[str]) -> DataFrame:
    """patch; reading it fails if it has several rows of a key, as none of them could be said to be the change."""
    several = F.count("*").over(Window.partitionBy(*keys)) > 1
    checked = patch.withColumn("larkspur_several", F.when(several, F.raise_error(F.lit("several rows of a patch have one key"))).otherwise(F.lit(False)).cast("boolean"))
    return checked.where(~F.col("larkspur_several")).drop("larkspur_several")


def insert_if_absent(base: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """base and incoming rows, with outcome: kept (of base), inserted, or rejected; of incoming ones that share a key the first in order counts."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    known = base.select(F.col(key).alias("larkspur_key")).distinct()
    rows = incoming.withColumn("larkspur_first", first).join(known, F.col(key) == F.col("larkspur_key"), "left")
    outcome = F.when(F.col("larkspur_first") & F.col("larkspur_key").isNull(), "inserted").otherwise("rejected")
    return base.withColumn("outcome", F.lit("kept")).unionByName(rows.withColumn("outcome", outcome).drop("larkspur_first", "larkspur_key"))


def upsert(base: DataFrame, patch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """base with the values of patch wherever its keys are there, and patch's other rows added. A patch of several rows for a key is refused."""
    p = patch.select(*keys, F.lit(True).alias("larkspur_patched"), *[F.col(v).alias(f"larkspur_{v}") for v in values])
    rows = base.join(one_per_key(p, keys), keys, "full_outer")
    return rows.select(*keys, *[F.when(F.col("larkspur_patched"), F.col(f"larkspur_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both maps; of a key in both, also if its value is null, the new one."""
    keys = F.map_keys(new)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(keys, k)), new)


def merge_json(base: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """base, all its columns, with its JSON objects overlaid by those of patch; the column becomes a map of texts, in which nested values are JSON texts.

    A patch of several rows for a key is refused.
    """
    kind = "map<string,string>"
    base, patch = dealt((base, key), (patch, key))
    new = one_per_key(patch.select(key, F.from_json(column, kind).alias("larkspur_new")), [key])
    old = F.coalesce(F.from_json(column, kind), F.create_map().cast(kind))
    rows = base.withColumn(column, old).join(new, key, "left")
    return rows.withColumn(column, F.coalesce(merge_maps(F.col(column), F.col("larkspur_new")), column)).select(*base.columns)


def delete_cascade(base: DataFrame, children: DataFrame, gone: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(base, children) without the rows of the keys in gone."""
    g = gone.select(F.col(key).alias("gone_key"))
    return base.join(g, base[key] == g.gone_key, "left_anti"), children.join(g, children[parent_key] == g.gone_key, "left_anti")


def permit_update(permits: DataFrame, patch: DataFrame) -> DataFrame:
    """permit_no, file_url, qr_url, qr_text and superseded (array of URLs to delete) after a patch.

    patch: permit_no, and for each of file, qr and qr_text the new value and a flag has_... whether it is given. Only web
    addresses are kept as images. A new text drops the stored image; taking the file away drops the text, even a new one. A patch of several rows for a
    permit is refused.
    """
    rows = permits.join(one_per_key(patch, ["permit_no"]), "permit_no", "left").fillna(False, ["has_file", "has_qr", "has_qr_text"])
    text = F.when(F.col("has_qr_text"), clean(F.col("new_qr_text"), 4096)).otherwise(F.col("qr_text"))
    url = F.when(F.col("has_qr_text") & text.isNotNull(), None).when(F.col("has_qr"), F.when(is_url(F.col("new_qr")), F.col("new_qr"))).otherwise(F.col("qr_url"))
    file = F.when(F.col("has_file"), F.col("new_file")).otherwise(F.col("file_url"))
    removed = F.col("has_file") & (F.coalesce("new_file", F.lit("")) == "")
    rows = rows.withColumns({"next_file": file, "next_url": url, "next_text": F.when(~removed, text)})
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    gone_file = F.when(F.col("has_file") & filled(F.col("file_url")) & ~F.col("file_url").eqNullSafe(F.col("next_file")), F.col("file_url"))
    gone_url = F.when(filled(F.col("qr_url")) & ~F.col("qr_url").eqNullSafe(F.col("next_url")), F.col("qr_url"))
    return rows.select("permit_no", F.col("next_file").alias("file_url"), F.col("next_url").alias("qr_url"), F.col("next_text").alias("qr_text"), F.array_compact(F.array(gone_file, gone_url)).alias("superseded"))


def json_object(text: Column) -> Column:
    """A JSON object's entries as values of their own types, or null if the text is none. Numbers, nested objects and arrays stay what they are."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def object_text(entries: Column) -> Column:
    """The JSON text of such entries, in the order of their keys."""
    return F.to_json(F.call_function("to_variant_object", entries))


def merge_typed_json(base: DataFrame, patch: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(base with its JSON objects overlaid by those of patch, rows of patch that change nothing, with why).

    An entry of the patch replaces the one of its key as a whole, also by null or by a nested object; entries that it doesn't name stay, and no entry changes its type. A
    base that is null, or no object, counts as an empty one. The column comes back as JSON text, keys in order, where the patch gives
    anything, and untouched elsewhere. A patch of several rows for a key is refused.
    """
    base, patch = dealt((base, key), (patch, key))
    given = one_per_key(patch.select(F.col(key).alias("larkspur_key"), F.col(column).alias("larkspur_text")), ["larkspur_key"]).withColumn("larkspur_new", json_object(F.col("larkspur_text")))
    empty = F.create_map().cast("map<string,variant>")
    rows = base.join(given.where("larkspur_new is not null"), F.col(key) == F.col("larkspur_key"), "left")
    merged = object_text(merge_maps(F.coalesce(json_object(F.col(column)), empty), F.col("larkspur_new")))
    after = rows.withColumn(column, F.when(F.col("larkspur_key").isNotNull(), merged).otherwise(F.col(column))).select(*base.columns)
    known = base.select(F.col(key).alias("larkspur_known")).distinct()
    left = given.join(known, F.col("larkspur_key") == F.col("larkspur_known"), "left")
    why = F.when(F.col("larkspur_known").isNull(), "no such key").when(F.col("larkspur_new").isNull(), "no object")
    return after, left.select(F.col("larkspur_key").alias(key), why.alias("reason")).where("reason is not null")


def update_columns(base: DataFrame, patch: DataFrame, key: str, fields: list[str], blank: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(base after the patch, keys of the patch that base doesn't have).

    patch: key, and for each field that it may give the new value new_<field> and has_<field>, whether it is given: one that isn't stays, one given
    as null becomes null. Empty texts of the fields in blank become null. A patch of several rows for a key is refused.
    """
    base, patch = dealt((base, key), (patch, key))
    given = [f for f in fields if f"new_{f}" in patch.columns]
    value = lambda f: F.nullif(F.col(f"new_{f}"), F.lit("")) if f in blank else F.col(f"new_{f}")
    new = one_per_key(patch.select(F.col(key).alias("larkspur_key"), *[F.coalesce(F.col(f"has_{f}"), F.lit(False)).alias(f"has_{f}") for f in given], *[value(f).alias(f"new_{f}") for f in given]), ["larkspur_key"])
    rows = base.join(new, F.col(key) == F.col("larkspur_key"), "left")
    after = rows.select(*[F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in base.columns])
    missing = new.select("larkspur_key").join(base.select(F.col(key).alias("larkspur_base")), F.col("larkspur_key") == F.col("larkspur_base"), "left_anti")
    return after, missing.withColumnRenamed("larkspur_key", key)


def delete_keys(base: DataFrame, children: DataFrame, requested: DataFrame, key: str, parent_key: str, file: str = "file_url") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(base and children without what was deleted, outcomes: key and outcome (deleted or missing) of each key requested, freed: key and file of every file that goes with them).

    Children go with their parent, and so do the files of both. A key requested several times has one outcome, null keys have none; a file that several rows name
    is freed once for each key, and only if no row that is left names it.
    """
    asked = requested.select(F.col(key).alias("larkspur_key")).where("larkspur_key is not null").distinct()
    known = base.select(F.col(key).alias("larkspur_base")).distinct()
    outcomes = asked.join(known, F.col("larkspur_key") == F.col("larkspur_base"), "left").select(F.col("larkspur_key").alias(key), F.when(F.col("larkspur_base").isNull(), "missing").otherwise("deleted").alias("outcome"))
    gone = outcomes.where("outcome = 'deleted'").select(F.col(key).alias("larkspur_key"))
    rest = base.join(gone, F.col(key) == F.col("larkspur_key"), "left_anti")
    others = children.join(gone, F.col(parent_key) == F.col("larkspur_key"), "left_anti")
    files = lambda rows, k: rows.select(F.col(k).alias(key), F.col(file).alias("file")).where("file != ''")
    freed = files(base, key).unionAll(files(children, parent_key)).join(gone, F.col(key) == F.col("larkspur_key"), "left_semi").distinct()
    still = files(rest, key).unionAll(files(others, parent_key)).select("file")
    return rest, others, outcomes, freed.join(still, "file", "left_anti").select(key, "file")
