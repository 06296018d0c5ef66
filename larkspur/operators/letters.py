"""Alert letters: numbered lines joined in order into one text, and the templates of the recipients filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import long_date
from larkspur.operators.expiry import SUBJECT, alert_line, mailing_list, remaining_clause

#: Most lines of a letter. What is left goes into further letters, so that no list of lines grows with the alerts.
MOST_LINES = 50_000

#: What a template may name in braces.
SLOTS = ["count", "lines", "employee", "document", "state", "when", "expiry", "remaining", "warning", "haste"]


def joined_lines(rows: DataFrame, group: list[str], order: str, line: str, into: str) -> DataFrame:
    """For each group the texts of its lines, in order, with a line break between two, and their number as n. A group has as many rows as one text may have lines."""
    lines = F.sort_array(F.collect_list(F.struct(order, line)))
    return rows.groupBy(*group).agg(F.array_join(F.transform(lines, lambda x: x[line]), "\n").alias(into), F.count("*").alias("n"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with the values of its slots, each once: what a value itself has in braces stays as it is, and so do unknown names."""
    parts = F.regexp_extract_all(template, F.lit("\\{[a-z]+\\}|[^{]+|\\{"), F.lit(0))
    slots = F.create_map(*[x for name, value in values.items() for x in (F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(slots, p), p)), "")


def _clauses() -> dict[str, Column]:
    """The slots of a letter about one alert; the wordings are fixed values."""
    stage, days = F.col("stage"), F.col("remaining_days")
    late = stage == "overdue"
    when = F.when(late, F.concat(F.lit("منذ "), F.abs(days).cast("string"), F.lit(" يوم"))).when(stage == "today", "اليوم").otherwise(F.concat(F.lit("بعد "), days.cast("string"), F.lit(" أيام")))
    return {
        "employee": F.col("employee_name"),
        "document": F.col("type_label"),
        "state": F.when(late, "منتهية").otherwise("ستنتهي"),
        "when": when,
        "expiry": long_date(F.col("expiry")),
        "remaining": remaining_clause(stage, days),
        "warning": F.when(late, F.col("warning")),
        "haste": F.when(late, F.col("haste_late")).otherwise(F.col("haste_ahead")),
    }


def alert_letters(alerts: DataFrame, recipients: DataFrame, templates: DataFrame, most_lines: int = MOST_LINES) -> tuple[DataFrame, DataFrame]:
    """(letters: email, subject, kind, part, parts, n_alerts, body; rejects: email, error).

    alerts need pos, from 1 on without gaps. templates: email, single, batch, and the texts warning, haste_late and haste_ahead, which may be null. One alert makes a
    letter by the single template, for each recipient; more are numbered lines in one by the batch template, or, beyond most_lines, in several
    parts. A recipient without a template is rejected, and others get their letters. No alerts make no letters and no rejects.
    """
    people = mailing_list(recipients, templates)
    parts = F.floor((F.col("pos") - 1) / most_lines).cast("int").alias("part")
    lines = joined_lines(alerts.select(parts, "pos", alert_line(F.col("pos")).alias("line")), ["part"], "pos", "line", "lines").drop("n")
    # one row each: how many there are, and what a letter about one alone says
    total = alerts.agg(F.count("*").alias("n_alerts"), F.ceil(F.count("*") / most_lines).cast("int").alias("parts"))
    first = alerts.where("pos = 1").select("employee_name", "type_label", "stage", "remaining_days", "expiry")
    rows = lines.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(people))
    single = F.col("n_alerts") == 1
    body = F.when(single, filled(F.col("single"), _clauses())).otherwise(filled(F.col("batch"), {"count": F.col("n_alerts"), "lines": F.col("lines")}))
    kind = F.when(single, "single").otherwise("batch")
    letters = rows.where("known").select("email", F.lit(SUBJECT).alias("subject"), kind.alias("kind"), (F.col("part") + 1).alias("part"), "parts", "n_alerts", body.alias("body"))
    rejects = people.where("not known").crossJoin(F.broadcast(total.where("n_alerts > 0"))).select("email", F.concat(F.lit("no template for "), F.col("email")).alias("error"))
    return letters, rejects
