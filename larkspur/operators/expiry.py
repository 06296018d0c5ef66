"""The document-expiry scan: latest permit, alerts by the escalation ladder, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import long_date, stage
from larkspur.operators.joins import spread
from larkspur.operators.mutations import one_per_key

#: Fixed value: the subject of alert mails.
SUBJECT = "🔔 تنبيه بقرب انتهاء وثيقة موظف"
#: Document types are a small catalogue, and recipients a short list; a table of more is refused.
MOST_TYPES, MOST_RECIPIENTS = 1000, 1000


def latest_permits(permits: DataFrame) -> DataFrame:
    """One row per iqama: the permit of the newest issue date; of equal ones the least id. No date counts as 1970-01-01.

    A minimum of structs, so that each task first reduces its own rows.
    """
    newest = F.struct(F.datediff(F.lit("1970-01-01"), F.coalesce("issue_date", F.lit("1970-01-01").cast("date"))).alias("age"), "id", "permit_no", "issue_date", "expiry_date")
    return permits.groupBy("iqama").agg(F.min(newest).alias("p")).select("iqama", "p.id", "p.permit_no", "p.issue_date", "p.expiry_date")


def scan_expirations(employees: DataFrame, permits: DataFrame, document_types: DataFrame, today: str) -> DataFrame:
    """Alerts: employee_id, employee_name, type_key, type_label, sort_order, expiry, remaining_days, stage.

    One for each employee and document type whose remaining days hit a rung of the ladder. Types that name
    no known field, and missing dates, give none. Employees and permits without an iqama don't meet.
    """
    if document_types.limit(MOST_TYPES + 1).count() > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} document types")
    latest = latest_permits(permits.where("iqama is not null")).select(F.col("iqama").alias("p_iqama"), F.col("expiry_date").alias("ajeer_exp"))
    rows = employees.join(latest, spread(F.col("iqama"), F.col("id")) == F.col("p_iqama"), "left").crossJoin(F.broadcast(document_types))
    field = F.col("employee_field")
    expiry = F.when(field == "iqExp", F.col("iq_exp")).when(field == "licExp", F.col("lic_exp")).when(field == "ajeerExp", F.col("ajeer_exp"))
    rows = rows.withColumn("expiry", expiry).withColumn("remaining_days", F.datediff("expiry", F.lit(today).cast("date")))
    rows = rows.withColumn("stage", stage(F.col("remaining_days"))).where("stage is not null")
    return rows.select(F.col("id").alias("employee_id"), F.col("name").alias("employee_name"), F.col("key").alias("type_key"), F.col("label").alias("type_label"), "sort_order", "expiry", "remaining_days", "stage")


#: Fixed values in the next two: the wordings of alert texts.
def remaining_clause(stage_: Column, days: Column) -> Column:
    overdue = F.concat(F.lit("منتهية منذ "), F.abs(days).cast("string"), F.lit(" يوم"))
    return F.when(stage_ == "overdue", overdue).when(stage_ == "today", "تنتهي اليوم").otherwise(F.concat(F.lit("متبقي "), days.cast("string"), F.lit(" أيام")))


def alert_line(pos: Column) -> Column:
    """A numbered line of an alert list."""
    urgent = F.when(F.col("stage") == "overdue", " ⚠️ يتطلب إجراءً فوريًا").otherwise("")
    return F.concat(pos.cast("string"), F.lit(". "), F.concat_ws(" — ", "employee_name", "type_label", remaining_clause(F.col("stage"), F.col("remaining_days"))), urgent)


def mailing_list(recipients: DataFrame, templates: DataFrame) -> DataFrame:
    """Each recipient's address once, with the columns of its template, and known, whether there is one.

    Both are short lists; longer ones are refused, and so is a template list that has an address twice.
    """
    for rows, what in ((recipients, "recipients"), (templates, "templates")):
        if rows.limit(MOST_RECIPIENTS + 1).count() > MOST_RECIPIENTS:
            raise ValueError(f"more than {MOST_RECIPIENTS} {what}")
    people = recipients.select("email").where("email is not null").distinct()
    return people.join(one_per_key(templates, ["email"]).withColumn("known", F.lit(True)), "email", "left").fillna(False, ["known"])


def alert_mails(alerts: DataFrame, recipients: DataFrame, templates: DataFrame) -> DataFrame:
    """The mails' lines: email, subject, kind (single or batch), pos, line; error where a recipient has no template.

    alerts need pos. One alert makes a detailed mail, more make a list. A mail stays a table of lines; letters.alert_letters() joins them.
    """
    people = mailing_list(recipients, templates)
    total = alerts.agg(F.count("*").alias("n"))
    rows = alerts.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(people.select("email", "known")))
    single = F.concat_ws(" — ", "employee_name", "type_label", long_date(F.col("expiry")), remaining_clause(F.col("stage"), F.col("remaining_days")))
    error = F.when(~F.col("known"), F.concat(F.lit("no template for "), F.col("email")))
    kind = F.when(F.col("n") == 1, "single").otherwise("batch")
    return rows.select("email", F.lit(SUBJECT).alias("subject"), kind.alias("kind"), "pos", F.when(error.isNull(), F.when(F.col("n") == 1, single).otherwise(alert_line(F.col("pos")))).alias("line"), error.alias("error"))
