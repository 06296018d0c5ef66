"""Records out of JSON, partial updates by patches with presence flags, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import parse_date
from larkspur.functions.strings import uri_encode
from larkspur.operators.mutations import json_object, merge_maps, one_per_key

#: The keys of an employee's JSON, by the field of the record that each becomes.
EMPLOYEE_KEYS = {"eid": "الرقم الوظيفي", "name": "اسم العامل", "iqama": "رقم الإقامة", "iq_exp": "تاريخ انتهاء الإقامة", "lic_exp": "تاريخ انتهاء رخصة العمل"}
#: Fixed value: where the code of a permit is drawn.
QR_PATH = "/api/files/qr?permit="


def employee_records(employees: DataFrame) -> DataFrame:
    """id, eid, name, iqama, iq_exp, lic_exp (dates) from the JSON objects in `data`; a missing key, JSON's null, or no object, gives null.

    A date is a loose text, or a number, which counts milliseconds since 1970.
    """
    rows = employees.select("id", json_object(F.col("data")).alias("m"))
    value = lambda field: F.try_element_at("m", F.lit(EMPLOYEE_KEYS[field]))
    text = lambda field: F.try_variant_get(value(field), "$", "string")
    whole = lambda field: F.when(F.schema_of_variant(value(field)) == "BIGINT", F.try_variant_get(value(field), "$", "bigint"))
    date = lambda field: F.coalesce(F.when(whole(field).isNotNull(), F.timestamp_millis(whole(field)).cast("date")), parse_date(text(field)))
    return rows.select("id", *[text(f).alias(f) for f in ("eid", "name", "iqama")], *[date(f).alias(f) for f in ("iq_exp", "lic_exp")])


def update_employees(employees: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(employees after the patch, eids of the patch that are no employee's).

    employees: eid, iqama, name, data (map); patch: eid, data (map). Entries of the patch, null ones too, replace those of the same key;
    iqama and name are then those of the merged map, while eid stays as it is. A patch of several rows for an eid is refused.
    """
    new = one_per_key(patch.select(F.col("eid").alias("p_eid"), F.col("data").alias("p_data")), ["p_eid"])
    rows = employees.join(new, F.col("eid") == F.col("p_eid"), "left")
    merged = F.when(F.col("p_eid").isNotNull(), merge_maps(F.coalesce("data", F.create_map().cast("map<string,string>")), F.coalesce("p_data", F.create_map().cast("map<string,string>")))).otherwise(F.col("data"))
    rows = rows.withColumn("p_merged", merged)
    mirror = lambda field: F.when(F.col("p_eid").isNotNull(), F.try_element_at("p_merged", F.lit(EMPLOYEE_KEYS[field]))).otherwise(F.col(field)).alias(field)
    after = rows.select(*[mirror(c) if c in ("iqama", "name") else F.col("p_merged").alias(c) if c == "data" else F.col(c) for c in employees.columns])
    return after, patch.join(employees.select("eid"), "eid", "left_anti").select("eid")


def permit_records(permits: DataFrame) -> DataFrame:
    """permit, iqama, qr, qr_text, qr_auto: the stored image's address, or else that of one drawn from the text; empty texts count as none."""
    stored, text = F.nullif("qr_url", F.lit("")), F.nullif("qr_text", F.lit(""))
    drawn = F.when(text.isNotNull(), F.concat(F.lit(QR_PATH), uri_encode(F.col("permit_no"))))
    return permits.select(F.col("permit_no").alias("permit"), "iqama", F.coalesce(stored, drawn).alias("qr"), text.alias("qr_text"), (stored.isNull() & text.isNotNull()).alias("qr_auto"))


def overlay(base: DataFrame, patch: DataFrame, keys: list[str], fields: list[str], insert: bool = False) -> DataFrame:
    """base with the fields that the patch gives: columns new_<field>, and has_<field> that says whether it is given, also as null.

    insert: rows of the patch whose keys base hasn't are added, with null for what isn't given. Keys are not null, and a patch of several
    rows for a key is refused. Also returns old_<field> and patched (boolean), for what depends on the change.
    """
    p = one_per_key(patch.select(*keys, F.lit(True).alias("larkspur_met"), *[f"has_{f}" for f in fields], *[f"new_{f}" for f in fields]), keys)
    rows = base.join(p, keys, "full_outer" if insert else "left")
    given = lambda f: F.coalesce(F.col(f"has_{f}"), F.lit(False))
    after = [F.when(given(f), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    rest = [c for c in base.columns if c not in keys and c not in fields]
    return rows.select(*keys, *rest, *after, *[F.col(f).alias(f"old_{f}") for f in fields], F.coalesce("larkspur_met", F.lit(False)).alias("patched"))


def superseded(rows: DataFrame, field: str = "file_url") -> Column:
    """The address that an overlay took away, to be deleted; null for none."""
    old = F.nullif(f"old_{field}", F.lit(""))
    return F.when(F.col("patched") & ~old.eqNullSafe(F.col(field)), old)


RUN_FIELDS, ATTACHMENT_FIELDS = ["month_label", "status_key", "file_url"], ["label", "status_key", "file_url", "note"]


def update_runs(runs: DataFrame, attachments: DataFrame, run_patch: DataFrame, attachment_patch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, attachments, addresses of files to delete) after partial updates of runs and of their attachments.

    runs: id and RUN_FIELDS; attachments: run_id, key and ATTACHMENT_FIELDS; patches as overlay() has them. Attachments that a run hasn't are
    added to it, others keep what isn't given; patches of runs that aren't there do nothing.
    """
    new_runs = overlay(runs, run_patch, ["id"], RUN_FIELDS)
    theirs = attachment_patch.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    new_parts = overlay(attachments, theirs, ["run_id", "key"], ATTACHMENT_FIELDS, insert=True)
    gone = new_runs.select(F.col("id").alias("run_id"), F.lit(None).cast("string").alias("key"), superseded(new_runs).alias("url"))
    gone = gone.unionByName(new_parts.select("run_id", "key", superseded(new_parts).alias("url"))).where("url is not null")
    return new_runs.select(*runs.columns), new_parts.select(*attachments.columns), gone


def lookup(rows: DataFrame, column: str, value) -> DataFrame:
    """The rows of one key; the predicate reaches the scan."""
    return rows.where(F.col(column) == F.lit(value))


def ticket_lookup(tickets: DataFrame, key: str) -> DataFrame:
    """The ticket of an id, if the key is digits alone, or else of a number. Digits that no id can have find nothing."""
    if not (key.isascii() and key.isdigit()):
        return lookup(tickets, "ticket_no", key)
    return lookup(tickets, "id", int(key)) if int(key) < 1 << 63 else tickets.where(F.lit(False))


def permit_lookup(permits: DataFrame, permit_no: str, mapped: bool = True) -> DataFrame:
    """The permit of a number, as permit_records() shows it, or its row as it is."""
    found = lookup(permits, "permit_no", permit_no)
    return permit_records(found) if mapped else found


def code_tag(text: Column) -> Column:
    """The tag of the image that is drawn of a code's text, in quotes: 16 digits of its SHA-1; null for no text."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit('"qr-'), F.substring(F.sha1(text), 1, 16), F.lit('"')))
