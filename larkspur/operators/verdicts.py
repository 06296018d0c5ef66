"""Whether an expiry date that was read off a document is applied to its employee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import is_iso
from larkspur.functions.strings import digits

#: Document types that dates are read from, and the employee's column of each.
TARGETS = {"iqama": "iqama_expiry", "work_license": "license_expiry"}


def expiry_verdicts(extracted: DataFrame, employees: DataFrame) -> DataFrame:
    """extracted with reason, applied, attach_file and set_hijri.

    extracted: eid, doc_type, gregorian, hijri, document_id, file_url (texts); employees: eid, iqama and the columns of TARGETS.
    The first rule that fits decides: type unknown, employee missing, ids that differ, no date, an older or equal date, else applied.
    """
    e = employees.select("eid", "iqama", *TARGETS.values()).withColumn("known", F.lit(True))
    rows = extracted.join(e, "eid", "left")
    previous = F.lit(None).cast("string")
    for kind, column in TARGETS.items():
        previous = F.when(F.col("doc_type") == kind, F.col(column)).otherwise(previous)
    rows = rows.withColumn("previous", F.nullif(previous, F.lit("")))
    mine, theirs = digits(F.coalesce("iqama", F.lit(""))), digits(F.coalesce("document_id", F.lit("")))
    dated = is_iso(F.col("previous"))
    reason = (
        F.when(~F.coalesce(F.col("doc_type").isin(*TARGETS), F.lit(False)), "unknown_document_type")
        .when(F.col("known").isNull(), "employee_not_found")
        .when((mine != "") & (theirs != "") & (mine != theirs), "identity_mismatch")
        .when(~is_iso(F.col("gregorian")), "no_date")
        .when(dated & (F.col("gregorian") < F.col("previous")), "older_than_current")
        .when(dated & (F.col("gregorian") == F.col("previous")), "unchanged")
        .when(dated, "updated")
        .otherwise("set")
    )
    rows = rows.withColumn("reason", reason)
    applied = F.col("reason").isin("updated", "set")
    attach = ~F.col("reason").isin("unknown_document_type", "employee_not_found") & (F.coalesce("file_url", F.lit("")) != "")
    hijri = (applied | (F.col("reason") == "unchanged")) & (F.coalesce("hijri", F.lit("")) != "")
    return rows.select(*extracted.columns, "previous", "reason", applied.alias("applied"), attach.alias("attach_file"), hijri.alias("set_hijri"))
