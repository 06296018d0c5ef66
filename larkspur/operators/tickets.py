"""Tickets: live names, attention order, figures, timelines, and the change events of an update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.dates import is_iso
from larkspur.functions.strings import clean, one_of, overdue_badge, ticket_number
from larkspur.operators.joins import dealt, spread
from larkspur.operators.mutations import one_per_key
from larkspur.operators.ordering import with_position

#: The enumerations of tickets.
PRIORITIES = ["normal", "medium", "high", "urgent"]
STATUSES = ["open", "awaiting_counterparty", "awaiting_us", "in_progress", "completed", "cancelled"]
CLOSED = ["completed", "cancelled"]
TYPES = ["issue_permit", "renew_permit", "renew_iqama", "renew_work_license", "edit_data", "request_document", "replace_worker", "objection", "other"]
EVENT_KINDS = ["created", "status_changed", "priority_changed", "assignee_changed", "followup", "follow_up_date_changed", "edited", "closed", "reopened"]
#: Fixed value: the counterparty of a ticket that names none.
COUNTERPARTY = "شركة ضمان الأعمال"
#: Fields whose changes have a kind of their own, in the order of their events.
TRACKED = [("status", "status_changed"), ("priority", "priority_changed"), ("assignee_id", "assignee_changed"), ("follow_up_date", "follow_up_date_changed")]


def is_closed(status: Column | str = "status") -> Column:
    return F.col(status).isin(CLOSED) if isinstance(status, str) else status.isin(CLOSED)


def overdue_days(today: str) -> Column:
    late = F.datediff(F.lit(today).cast("date"), F.col("follow_up_date"))
    return F.when(~is_closed() & (late > 0), late).otherwise(0)


def due_today(today: str) -> Column:
    return F.coalesce(~is_closed() & (F.col("follow_up_date") == F.lit(today).cast("date")), F.lit(False))


def due_badge(today: str) -> Column:
    """A ticket's overdue days in words, or that it is due today; empty for neither. The wording is a fixed value."""
    late = overdue_days(today)
    return F.when(late > 0, overdue_badge(late)).when(due_today(today), "متابعة اليوم").otherwise("")


def ticket_list(tickets: DataFrame, employees: DataFrame, users: DataFrame) -> DataFrame:
    """Tickets with the employee's and assignee's live values.

    The iqama is the live one, even if null, wherever the employee exists, and else that of the ticket's creation.
    """
    e = employees.select(F.col("eid").alias("e_eid"), F.col("name").alias("employee_name"), F.col("iqama").alias("live_iqama"))
    u = users.select(F.col("id").alias("u_id"), F.nullif(F.col("name"), F.lit("")).alias("assignee_name"))
    rows = tickets.join(e, spread(F.col("employee_eid"), F.col("id")) == F.col("e_eid"), "left")
    rows = rows.join(u, spread(F.col("assignee_id"), F.col("id")) == F.col("u_id").cast("string"), "left")
    exists = F.col("e_eid").isNotNull()
    return rows.withColumns({"employee_exists": exists, "iqama": F.when(exists, F.col("live_iqama")).otherwise(F.col("employee_iqama_at_creation")), "is_closed": is_closed()}).drop("e_eid", "u_id", "live_iqama")


def attention_order(tickets: DataFrame, today: str) -> DataFrame:
    """tickets with rank, overdue and pos: overdue ones first, then urgent (closed or not), due today, and the rest."""
    rank = F.when(F.col("overdue") > 0, 0).when(F.col("priority") == "urgent", 1).when(due_today(today), 2).otherwise(3)
    rows = tickets.withColumn("overdue", overdue_days(today)).withColumn("rank", rank)
    return with_position(rows, F.col("rank").asc(), F.col("overdue").desc(), F.coalesce("follow_up_date", F.lit("9999-12-31").cast("date")).asc(), F.col("id").desc())


def summary(tickets: DataFrame, today: str) -> DataFrame:
    """The five figures, in one pass."""
    month = F.date_format("closed_at", "yyyy-MM") == today[:7]
    return tickets.agg(
        F.count_if(~is_closed()).alias("open"),
        F.count_if(F.col("status") == "awaiting_counterparty").alias("awaiting_counterparty"),
        F.count_if(F.col("status") == "awaiting_us").alias("awaiting_us"),
        F.count_if(overdue_days(today) > 0).alias("overdue"),
        F.count_if((F.col("status") == "completed") & month).alias("completed_this_month"),
    )


def timeline(events: DataFrame) -> DataFrame:
    """Events with pos, their place in their ticket: by their time, if they have one, and then by id. An event without a time stands after those with one."""
    order = [F.col("at").asc_nulls_last(), F.col("id").asc()] if "at" in events.columns else [F.col("id").asc()]
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("ticket_id").orderBy(*order)))


#: What is shown of a ticket besides live values, in order, and of an event.
TICKET_FIELDS = ["ticket_no", "title", "description", "type", "priority", "status", "counterparty", "employee_eid", "employee_iqama_at_creation", "created_by_id", "created_by_name", "assignee_id", "opened_at", "last_followup_at", "follow_up_date", "closed_at", "notes"]
EVENT_FIELDS = ["kind", "body", "from_value", "to_value", "actor_id", "actor_name", "at"]


def ticket_records(tickets: DataFrame, employees: DataFrame, users: DataFrame) -> DataFrame:
    """All that is shown of tickets: their id as text, TICKET_FIELDS with the follow-up date as text, is_closed, and the live values: employee_exists, employee_name, iqama, assignee_name."""
    rows = ticket_list(tickets, employees, users)
    shown = [F.date_format(c, "yyyy-MM-dd").alias(c) if c == "follow_up_date" else F.col(c) for c in TICKET_FIELDS]
    return rows.select(F.col("id").cast("string").alias("id"), *shown, "is_closed", "employee_exists", "employee_name", "iqama", "assignee_name")


def with_events(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """tickets with events, an array of all that is shown of their events, ordered by time and then id; empty for a ticket without any.

    An event without a time stands after those with one. Events of tickets that aren't there are left out. One shuffle of the events by ticket.
    """
    shown = F.struct(F.col("at").isNull().alias("late"), F.col("at").alias("on"), F.col("id").alias("number"), F.struct(F.col("id").cast("string").alias("id"), *EVENT_FIELDS).alias("event"))
    lists = events.groupBy(F.col("ticket_id").alias("larkspur_ticket")).agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["event"]).alias("events"))
    rows = tickets.join(lists, F.col("id") == F.col("larkspur_ticket"), "left").drop("larkspur_ticket")
    return rows.withColumn("events", F.coalesce("events", F.array().cast(lists.schema["events"].dataType)))


def numbered(tickets: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """tickets with year, seq and ticket_no, in the order of opened_at and id within each year; last: (year, last_seq) given out before.

    Years are few and large, so positions come from one distributed sort, not from a window a year.
    """
    placed = with_position(tickets.withColumn("year", F.year("opened_at")), F.col("year").asc(), F.col("opened_at").asc(), F.col("id").asc(), name="place")
    base = placed.groupBy("year").agg(F.min("place").alias("first"))
    base = base.join(last, "year", "left").select("year", "first", F.coalesce("last_seq", F.lit(0)).alias("before")) if last is not None else base.withColumn("before", F.lit(0))
    rows = placed.join(F.broadcast(base), "year").withColumn("seq", F.col("place") - F.col("first") + 1 + F.col("before"))
    return rows.withColumn("ticket_no", ticket_number(F.col("year"), F.col("seq"))).drop("place", "first", "before")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _changed(old: DataFrame, patch: DataFrame, plain: tuple[str, ...]) -> DataFrame:
    """Tickets of ids in both, with new_<field> for all fields: what the patch gives, or the old value.

    A field is given if the patch has its column, and, if the patch has a column has_<field> too, where that is true. Rows whose given
    status or priority is unknown are left out.
    """
    old, patch = dealt((old, "id"), (patch, "id"))
    names = [c for c, _ in TRACKED] + list(plain)
    given = [c for c in names if c in patch.columns]
    flag = lambda c: F.coalesce(F.col(f"has_{c}"), F.lit(False)) if f"has_{c}" in patch.columns else F.lit(True)
    value = lambda c: clean(F.col(c)) if c in plain else F.col(c)
    new = patch.select("id", *[flag(c).alias(f"given_{c}") for c in given], *[value(c).alias(f"patch_{c}") for c in given])
    rows = old.join(one_per_key(new, ["id"]), "id")
    rows = rows.withColumns({f"new_{c}": F.when(F.col(f"given_{c}"), F.col(f"patch_{c}")).otherwise(F.col(c)) if c in given else F.col(c) for c in names})
    for c, allowed in (("status", STATUSES), ("priority", PRIORITIES)):
        if c in given:
            rows = rows.where(~F.col(f"given_{c}") | F.coalesce(F.col(f"new_{c}").isin(allowed), F.lit(False)))
    return rows


def change_events(old: DataFrame, patch: DataFrame, plain: tuple[str, ...] = ()) -> DataFrame:
    """Events of updating tickets by a patch, for ids in both: ticket_id, seq, kind, from_value, to_value.

    A patch has id and any of the fields, and may have has_<field> to say where a field is given. A field that isn't given, or of equal
    value, null and empty alike, gives none. Tracked fields come first, then plain ones as edits, then
    the closing or reopening. Patches with an unknown status or priority change nothing; several for a ticket are refused.
    """
    rows = _changed(old, patch, plain)
    differs = lambda c: F.coalesce(_text(c), F.lit("")) != F.coalesce(_text(f"new_{c}"), F.lit(""))
    event = lambda seq, kind, a, b, on: F.when(on, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), a.alias("from_value"), b.alias("to_value")))
    events = [event(k, kind, _text(c), _text(f"new_{c}"), differs(c)) for k, (c, kind) in enumerate(TRACKED)]
    events += [event(10 + k, "edited", F.lit(c), F.coalesce(F.substring(_text(f"new_{c}"), 1, 200), F.lit("—")), differs(c)) for k, c in enumerate(plain)]
    was, now, none = is_closed(), F.col("new_status").isin(CLOSED), F.lit(None).cast("string")
    events += [event(100, "closed", none, _text("new_status"), now & ~was), event(101, "reopened", _text("status"), _text("new_status"), was & ~now)]
    return rows.select(F.col("id").alias("ticket_id"), F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")).select("ticket_id", "e.*")


def updated(old: DataFrame, patch: DataFrame, at: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """old after a patch as change_events() takes it: closing stamps closed_at with `at`, reopening clears it; rows without a valid patch stay."""
    changed = _changed(old, patch, plain)
    names = [c for c, _ in TRACKED] + list(plain)
    now = F.col("new_status").isin(CLOSED)
    closed_at = F.when(now & ~is_closed(), F.lit(at).cast(old.schema["closed_at"].dataType)).when(is_closed() & ~now, None).otherwise(F.col("closed_at"))
    after = changed.select(*[closed_at.alias(c) if c == "closed_at" else F.col(f"new_{c}").alias(c) if c in names else F.col(c) for c in old.columns])
    return after.unionByName(old.join(changed.select("id"), "id", "left_anti").select(*old.columns))


def created(inputs: DataFrame, employees: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """inputs with what becomes of each: outcome, ticket_no, and the new ticket's values.

    inputs: id, opened_at, title, type, priority, status, counterparty, employee_eid, assignee_id, follow_up_date (texts but for the first
    two). A ticket needs a title, a known type and, if it names an employee, one that exists, whose iqama it keeps. Unknown
    priorities and statuses become the first of theirs, dates of another shape null. Only created tickets take a number.
    """
    e = employees.select(F.col("eid").alias("e_eid"), F.nullif("iqama", F.lit("")).alias("employee_iqama_at_creation"))
    rows = inputs.withColumns(
        {
            "title": clean(F.col("title"), 300),
            "type": one_of(F.col("type"), TYPES, None),
            "priority": one_of(F.col("priority"), PRIORITIES, "normal"),
            "status": one_of(F.col("status"), STATUSES, "open"),
            "counterparty": F.coalesce(clean(F.col("counterparty"), 200), F.lit(COUNTERPARTY)),
            "employee_eid": clean(F.col("employee_eid"), 60),
            "assignee_id": clean(F.col("assignee_id"), 60),
            "follow_up_date": F.when(is_iso(F.col("follow_up_date")), F.col("follow_up_date")),
        }
    ).join(e, spread(F.col("employee_eid"), F.col("id")) == F.col("e_eid"), "left")
    outcome = F.when(F.col("title").isNull(), "no_title").when(F.col("type").isNull(), "unknown_type").when(F.col("employee_eid").isNotNull() & F.col("e_eid").isNull(), "no_such_employee")
    rows = rows.withColumn("outcome", F.coalesce(outcome, F.lit("created"))).drop("e_eid")
    made = numbered(rows.where("outcome = 'created'"), last).drop("year", "seq")
    return made.unionByName(rows.where("outcome != 'created'").withColumn("ticket_no", F.lit(None).cast("string")))


def event(ticket: Column, kind: Column, at: Column, body: Column, from_value: Column, to_value: Column) -> list[Column]:
    """An event's columns: an unknown kind becomes an edit, a body is cut at 4000 characters and values at 200."""
    return [ticket.alias("ticket_id"), one_of(kind, EVENT_KINDS, "edited").alias("kind"), at.alias("at"), clean(body).alias("body"), clean(from_value, 200).alias("from_value"), clean(to_value, 200).alias("to_value")]


def _event_row(ticket: Column, seq: int, kind: str, at: Column, body: Column | None = None, from_value: Column | None = None, to_value: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    columns = event(ticket, F.lit(kind), at, none if body is None else body, none if from_value is None else from_value, none if to_value is None else to_value)
    return F.struct(*columns, F.lit(seq).alias("seq"), *[F.col(c).cast("string").alias(c) for c in ACTOR])


#: Who an event is by.
ACTOR = ["actor_id", "actor_name", "actor_email"]


def creation(inputs: DataFrame, employees: DataFrame, last: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tickets made, their events, rejects: id and outcome) of inputs as created() takes them, with the actor's id, name and email.

    Each ticket made has one event, that it was created, which names its number. A request that is refused takes no number and leaves no event.
    """
    rows = created(inputs, employees, last)
    made = rows.where("outcome = 'created'")
    text = F.lit(None).cast("string")
    events = made.select(_event_row(F.col("id"), 0, "created", F.col("opened_at"), text, text, F.col("ticket_no")).alias("e")).select("e.*")
    return made.drop("outcome", *ACTOR), events, rows.where("outcome != 'created'").select("id", "outcome")


def follow_ups(tickets: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tickets after the notes, the events that they make, rejects: id and outcome): all of a note or nothing of it.

    notes: id, ticket_id, at, body, has_ and new_ of status and follow_up_date (texts), and the actor's id, name and email. A note needs a ticket that
    exists, a text, and a known status if it gives one. It makes an event of its own, and stamps the ticket's last_followup_at; the status and the date that it gives change the
    ticket and make their events, and closing or reopening sets or clears closed_at. A date of another shape, or null, clears the ticket's.

    Notes of one ticket take effect in the order of their times and ids, each upon what those before it left: what a field was before a note is
    the last value given before, or the ticket's own. A note without a time comes first.
    """
    tickets, notes = dealt((tickets, "id"), (notes, "ticket_id"))
    t = tickets.select(F.col("id").alias("t_id"), F.col("status").alias("t_status"), F.col("follow_up_date").cast("string").alias("t_date"))
    rows = notes.join(t, F.col("ticket_id") == F.col("t_id"), "left")
    given = lambda c: F.coalesce(F.col(f"has_{c}"), F.lit(False))
    bad = given("status") & ~F.coalesce(F.col("new_status").isin(STATUSES), F.lit(False))
    outcome = F.when(F.col("t_id").isNull(), "no_such_ticket").when(clean(F.col("body")).isNull(), "no_text").when(bad, "unknown_status").otherwise("added")
    rows = rows.withColumn("outcome", outcome)
    date = F.when(is_iso(F.col("new_follow_up_date")), F.col("new_follow_up_date"))
    order = Window.partitionBy("ticket_id").orderBy(F.col("at").asc_nulls_first(), F.col("id").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a value given, even null, is a struct; none given is no struct
    added = rows.where("outcome = 'added'").withColumns({"gave_status": F.when(given("status"), F.struct(F.col("new_status").alias("v"))), "gave_date": F.when(given("follow_up_date"), F.struct(date.alias("v")))})
    last_status, last_date = F.last("gave_status", ignorenulls=True).over(before), F.last("gave_date", ignorenulls=True).over(before)
    added = added.withColumns({"old_status": F.when(last_status.isNull(), F.col("t_status")).otherwise(last_status["v"]), "old_date": F.when(last_date.isNull(), F.col("t_date")).otherwise(last_date["v"])})
    added = added.withColumns({"next_status": F.when(F.col("gave_status").isNotNull(), F.col("new_status")).otherwise(F.col("old_status")), "next_date": F.when(F.col("gave_date").isNotNull(), F.col("gave_date.v")).otherwise(F.col("old_date"))})
    was, now = (F.coalesce(is_closed(c), F.lit(False)) for c in ("old_status", "next_status"))
    differs = lambda a, b: F.coalesce(F.col(a), F.lit("")) != F.coalesce(F.col(b), F.lit(""))
    ticket, at = F.col("ticket_id"), F.col("at")
    made = [
        _event_row(ticket, 0, "followup", at, F.col("body")),
        F.when(differs("old_status", "next_status"), _event_row(ticket, 1, "status_changed", at, None, F.col("old_status"), F.col("next_status"))),
        F.when(differs("old_date", "next_date"), _event_row(ticket, 2, "follow_up_date_changed", at, None, F.col("old_date"), F.col("next_date"))),
        F.when(now & ~was, _event_row(ticket, 3, "closed", at, None, None, F.col("next_status"))),
        F.when(was & ~now, _event_row(ticket, 4, "reopened", at, None, F.col("old_status"), F.col("next_status"))),
    ]
    events = added.select(F.col("id").alias("note_id"), F.explode(F.filter(F.array(*made), lambda e: e.isNotNull())).alias("e")).select("note_id", "e.*")
    # what the notes of a ticket come to
    place = F.struct(F.col("at").isNotNull().alias("timed"), F.col("at"), F.col("id"))
    moved = F.when(now != was, place)
    after = added.groupBy("ticket_id").agg(F.max("at").alias("noted_at"), F.max_by("next_status", place).alias("next_status"), F.max_by("next_date", place).alias("next_date"), F.max(moved).alias("moved"), F.max_by(F.when(now, F.col("at")), moved).alias("closed_on"))
    out = tickets.join(after.withColumnRenamed("ticket_id", "n_ticket"), F.col("id") == F.col("n_ticket"), "left")
    noted = F.col("n_ticket").isNotNull()
    kinds = {f.name: f.dataType for f in tickets.schema.fields}
    closed = F.when(F.col("moved").isNull(), F.col("closed_at")).otherwise(F.col("closed_on").cast(kinds["closed_at"]))
    values = {
        "status": F.when(noted, F.col("next_status")).otherwise(F.col("status")),
        "follow_up_date": F.when(noted, F.col("next_date").try_cast(kinds["follow_up_date"])).otherwise(F.col("follow_up_date")),
        "closed_at": F.when(noted, closed).otherwise(F.col("closed_at")),
        "last_followup_at": F.when(noted & F.col("noted_at").isNotNull(), F.col("noted_at").cast(kinds["last_followup_at"])).otherwise(F.col("last_followup_at")),
    }
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in tickets.columns]), events, rows.where("outcome != 'added'").select("id", "outcome")


def followed_up(tickets: DataFrame, notes: DataFrame) -> DataFrame:
    """What becomes of notes (id, ticket_id, at, body, and has_/new_ of status and follow_up_date) on tickets: outcome, and the event's columns.

    A note needs a ticket that exists, a text, and a known status if it gives one: a note that is refused leaves nothing behind. The
    changes that the notes give are those of change_events(), for a patch of the notes that are accepted.
    """
    tickets, notes = dealt((tickets, "id"), (notes, "ticket_id"))
    t = tickets.select(F.col("id").alias("t_id"))
    rows = notes.join(t, F.col("ticket_id") == F.col("t_id"), "left")
    bad = F.coalesce(F.col("has_status"), F.lit(False)) & ~F.coalesce(F.col("new_status").isin(STATUSES), F.lit(False))
    outcome = F.when(F.col("t_id").isNull(), "no_such_ticket").when(clean(F.col("body")).isNull(), "no_text").when(bad, "unknown_status").otherwise("added")
    none = F.lit(None).cast("string")
    return rows.select("id", outcome.alias("outcome"), *event(F.col("ticket_id"), F.lit("followup"), F.col("at"), F.col("body"), none, none))
