"""The registered queries over the workforce tables, and the DuckDB SQL of each that SQL can express."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, strings
from larkspur.operators import expiry, hijri, mutations, nested, pdf_images, permissions, tickets, users, verdicts
from larkspur.operators.ordering import with_position
from larkspur.plans.oracles import ORACLES
from larkspur.sources.views import AS_OF, TODAY, table, view

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _text(*names: str):
    return [F.col(n).cast("string").alias(n) for n in names]


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.scan_expirations(*(view(spark, sf_dir, v) for v in ("employees", "permits", "document_types")), today=AS_OF)


@query
def expiry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all employees and document types."""
    return alerts(spark, sf_dir).select("employee_id", "employee_name", "type_label", *_text("expiry"), "remaining_days", "stage")


@query
def latest_permit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest permit of each iqama."""
    return expiry.latest_permits(view(spark, sf_dir, "permits")).select("iqama", "id", "permit_no", *_text("issue_date", "expiry_date"))


@query
def date_parse_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in a dozen loose ways, some of which are none, and what they are parsed to."""
    d, k = F.col("d"), F.col("id") % 12
    y, m, t = (f(d).cast("string") for f in (F.year, F.month, F.dayofmonth))
    joined = lambda by, *parts: F.concat_ws(by, *parts)
    iso, none = d.cast("string"), F.lit(None).cast("string")
    later, beyond = (F.month(d) + 12).cast("string"), (F.dayofmonth(d) + 31).cast("string")
    ways = [none, F.lit(""), iso, joined("-", y, m, t), joined("/", m, t, y), joined("/", later, t, y), joined("/", m, beyond, y), joined("/", m, t, F.right(y, F.lit(2)))]
    ways += [F.concat(iso, F.lit("T10:00:00Z")), joined("-", y, m), joined("-", y, later, F.lit("01")), F.concat(iso, F.lit(" 10:00"))]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    rows = rows.select("id", F.get(F.array(*ways), k.cast("int")).alias("text"))
    return rows.select("id", "text", dates.parse_date(F.col("text")).cast("string").alias("parsed"))


@query
def alert_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the alert mail of each recipient."""
    rows = with_position(alerts(spark, sf_dir), F.col("employee_id").asc(), F.col("sort_order").asc(), F.col("type_key").asc())
    templates = spark.createDataFrame([("first@example.org", "hello")], "email string, greeting string")
    return expiry.alert_mails(rows, view(spark, sf_dir, "recipients"), templates)


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.ticket_list(*(view(spark, sf_dir, v) for v in ("tickets", "employees", "users")))


_LISTED = ["id", "employee_eid", "employee_exists", "iqama", "employee_name", "assignee_name", "status", "is_closed"]


@query
def ticket_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with live names."""
    return _list(spark, sf_dir).select(*_LISTED)


@query
def ticket_by_employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickets of one employee, the newest first; the predicate reaches the scan."""
    return with_position(_list(spark, sf_dir).where(F.col("employee_eid") == "E7").select(*_LISTED), F.col("id").desc())


@query
def ticket_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each ticket, in order."""
    return tickets.timeline(view(spark, sf_dir, "ticket_events")).select("ticket_id", "pos", "kind", "body")


@query
def ticket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five figures."""
    return tickets.summary(view(spark, sf_dir, "tickets"), TODAY)


@query
def ticket_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickets by the attention they need."""
    return tickets.attention_order(view(spark, sf_dir, "tickets"), TODAY).select("id", "rank", "overdue", "pos")


@query
def payroll_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, of the highest id first, and their attachments, nested by one shuffle and shown flat."""
    events = view(spark, sf_dir, "ticket_events")
    runs = events.select(F.col("ticket_id").alias("run_id")).distinct()
    children = events.select(F.col("ticket_id").alias("run_id"), "id", F.col("kind").alias("key"), F.col("body").alias("note"))
    rows = with_position(nested.nest(runs, children, "run_id", "id", "attachments"), F.col("run_id").desc(), name="place")
    rows = rows.select("run_id", "place", F.size("attachments").alias("n"), F.posexplode_outer("attachments").alias("pos", "a"))
    return rows.select("run_id", "place", "n", "pos", "a.key", "a.note")


@query
def settings_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings folded into a map and shown flat."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return nested.fold_map(rows, "key", "value").select(F.explode("settings").alias("key", "value"))


@query
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 entries, all that is shown of them."""
    k = F.col("event_id")
    log = table(spark, sf_dir, "events").select(k.alias("id"), "ts", F.col("event_type").alias("type"), F.when(k % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org"))).alias("actor_email"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor_id"), F.when(k % 2 == 0, k.cast("string")).alias("target_id"), F.col("props").alias("meta"))
    return users.audit_tail(log).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query
def doc_types_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as document types, in their order."""
    types = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 4).alias("sort_order"))
    return with_position(types, F.col("sort_order").asc(), F.col("key").asc()).select("key", "label", F.col("pos").cast("int").alias("pos"))


def held_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with stored permissions: none, an array with a stale one, or an empty array."""
    custom = F.array(*map(F.lit, ["tickets:view", "gone:view", "users:manage", "kpi:view", "kpi:view"]))
    stored = F.when(F.col("perm_mode") == 1, custom).when(F.col("perm_mode") == 2, F.array().cast("array<string>"))
    rows = view(spark, sf_dir, "users").withColumn("stored", stored)
    return rows.withColumn("held", permissions.effective(F.col("role"), F.col("stored"))).withColumn("defaults", permissions.uses_defaults(F.col("role"), F.col("stored")))


@query
def user_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective permissions of all users, in catalogue order."""
    rows = held_users(spark, sf_dir).select("id", "role", "defaults", F.posexplode("held").alias("pos", "permission"))
    return rows


@query
def permission_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against each user's giving the next one a fixed set of permissions."""
    held = held_users(spark, sf_dir)
    target = held.select(F.col("id").alias("target_id"), F.col("role").alias("target_role"))
    rows = held.join(target, F.col("id") + 1 == F.col("target_id"))
    wanted = F.array(*map(F.lit, ["settings:edit", "kpi:view", "stale:one", "users:view"]))
    return rows.select("id", "target_id", permissions.change_verdict(F.col("role"), F.col("held"), F.col("id"), F.col("target_role"), F.col("target_id"), wanted).alias("verdict"))


@query
def ticket_status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each ticket's assignee may set each status."""
    held = held_users(spark, sf_dir).select(F.col("id").alias("u_id"), "role", "held")
    rows = view(spark, sf_dir, "tickets").join(held, F.col("assignee_id") == F.col("u_id"))
    rows = rows.withColumn("wanted", F.explode(F.array(*map(F.lit, tickets.STATUSES))))
    return rows.select("id", "wanted", permissions.may_set_status(F.col("role"), F.col("held"), F.col("status"), F.col("wanted")).alias("allowed"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"))


@query
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inserted by customer, where no finished order of the customer is there yet."""
    rows = _orders(spark, sf_dir)
    return mutations.insert_if_absent(rows.where("value = 'F'"), rows.where("value != 'F'"), "key", "seq")


@query
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names and balances, with suppliers' over those of the same key."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    patch = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(None).cast("double").alias("balance"))
    return mutations.upsert(base, patch, ["key"], ["name", "balance"])


@query
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON overlaid by a patch of the purchases, entry by entry."""
    events = table(spark, sf_dir, "events")
    patch = events.where("event_type = 'purchase'").select("event_id", F.to_json(F.struct(F.lit("patched").alias("k"), F.col("user_id").alias("u"))).alias("props"))
    rows = mutations.merge_json(events.select("event_id", "props"), patch, "event_id", "props")
    return rows.select("event_id", F.explode("props").alias("key", "value"))


@query
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of an update of all tickets by a rule."""
    old = view(spark, sf_dir, "tickets")
    status = F.when(F.col("status") == "open", "completed").when(F.col("status") == "cancelled", "in_progress").when(F.col("priority") == "high", "nonsense").otherwise(F.col("status"))
    day = F.when(F.col("priority") == "urgent", F.lit(None).cast("date")).otherwise(F.col("follow_up_date"))
    owner = F.when(F.col("priority") == "medium", F.col("assignee_id") + 1).otherwise(F.col("assignee_id"))
    eid = F.when(F.col("status") == "awaiting_us", F.concat(F.lit("  "), "employee_eid", F.lit("x "))).otherwise(F.col("employee_eid"))
    patch = old.withColumns({"status": status, "follow_up_date": day, "assignee_id": owner, "employee_eid": eid})
    return tickets.change_events(old, patch, plain=("employee_eid",))


@query
def ticket_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all tickets, given out by year."""
    return tickets.numbered(view(spark, sf_dir, "tickets")).select("id", "year", "seq", "ticket_no")


@query
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of tickets and their events when the cancelled ones go."""
    all_ = view(spark, sf_dir, "tickets")
    base, events = mutations.delete_cascade(all_.select("id"), view(spark, sf_dir, "ticket_events").select("ticket_id", F.col("id").alias("turn")), all_.where("status = 'cancelled'"), "id", "ticket_id")
    return base.select(F.lit("ticket").alias("kind"), "id", F.lit(None).cast("long").alias("turn")).unionAll(events.select(F.lit("event").alias("kind"), F.col("ticket_id").alias("id"), F.col("turn").cast("long")))


@query
def expiry_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on dates read off documents of all customers and some that don't exist."""
    e = view(spark, sf_dir, "employees")
    employees = e.select("eid", "iqama", F.when(F.col("id") % 7 == 0, "soon").otherwise(F.col("iq_exp").cast("string")).alias("iqama_expiry"), F.col("lic_exp").cast("string").alias("license_expiry"))
    return verdicts.expiry_verdicts(_extracted(e), employees).select("eid", "doc_type", "previous", "reason", "applied", "attach_file", "set_hijri")


def _extracted(e: DataFrame) -> DataFrame:
    k = F.col("id")
    day = F.when(k % 11 == 0, None).when(k % 13 == 0, "2001/08/01").when(k % 3 == 0, F.col("iq_exp").cast("string")).when(k % 3 == 1, "2001-08-03").otherwise("2002-01-31")
    return e.select(
        F.when(k % 17 == 0, F.concat(F.lit("X"), "eid")).otherwise(F.col("eid")).alias("eid"),
        F.when(k % 19 == 0, "passport").when(k % 2 == 0, "iqama").otherwise("work_license").alias("doc_type"),
        day.alias("gregorian"),
        F.when(k % 5 == 0, "1422-05-11").alias("hijri"),
        F.when(k % 23 == 0, "00-1").when(k % 4 == 0, F.concat(F.lit("no. "), "iqama")).alias("document_id"),
        F.when(k % 6 != 0, F.concat(F.lit("https://files/"), "eid")).alias("file_url"),
    )


@query
def permit_qr_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permits' files and codes after a patch by rule."""
    k = F.col("id")
    permits = view(spark, sf_dir, "permits").select("permit_no", "id", F.when(k % 4 != 0, F.concat(F.lit("https://f/"), "permit_no")).alias("file_url"), F.when(k % 3 == 0, F.concat(F.lit("https://q/"), "permit_no")).alias("qr_url"), F.when(k % 5 == 0, "old text").alias("qr_text"))
    patch = permits.where(k % 10 != 9).select(
        "permit_no",
        (k % 2 == 0).alias("has_file"), F.when(k % 8 != 0, "https://f/new").alias("new_file"),
        (k % 3 == 0).alias("has_qr"), F.when(k % 9 == 0, "HTTPS://q/new").when(k % 6 == 0, "/api/qr").alias("new_qr"),
        (k % 7 == 0).alias("has_qr_text"), F.when(k % 14 == 0, "  new text ").when(k % 21 == 0, " ").alias("new_qr_text"),
    )
    rows = mutations.permit_update(permits.drop("id"), patch)
    return rows.select("permit_no", "file_url", "qr_url", "qr_text", F.array_join("superseded", " ").alias("superseded"))


@query
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules over the addresses of all pages."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.clean(F.concat(F.lit(" \t"), url, F.lit("\n ")), 20).alias("cleaned"), strings.digits(url).alias("digits"), strings.safe_filename(url).alias("file"), strings.safe_prefix(url).alias("prefix"), strings.escape_html(F.concat(F.lit('<a href="'), url, F.lit('">&'))).alias("escaped"), strings.is_url(url).alias("is_url"))


@query
def hijri_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates by the Umm al-Qura calendar, and back."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    rows = hijri.to_gregorian(hijri.to_hijri(days, "day"), "hijri")
    return rows.select(*_text("day"), "hijri", F.col("gregorian").cast("string").alias("back"))


def text_document(page_id: int, payload: str) -> bytes:
    """A PDF of a page's text: images of its bytes, of several sizes, in gray or in colours, with rows filtered in all five ways, and one of a depth that isn't read."""
    data = payload.encode("ascii")
    out = [b"%PDF-1.4\n"]
    for k in range(1 + page_id % 5):
        w, h, channels = 2 + (page_id + 3 * k) % 9, 2 + (page_id * 7 + k) % 9, 1 if (page_id + k) % 2 else 3
        row = w * channels
        pixels = np.frombuffer(data[: h * row].ljust(h * row, b"."), np.uint8).reshape(h, w, channels).astype(np.int64)
        lines, none = [], np.zeros((w, channels), np.int64)
        for y in range(h):
            up = pixels[y - 1] if y else none
            left, corner = np.vstack((none[:1], pixels[y][:-1])), np.vstack((none[:1], up[:-1]))
            far = np.abs(np.stack((up - corner, left - corner, left + up - 2 * corner)))
            guess = (0 * up, left, up, (left + up) // 2, np.choose(np.argmin(far, axis=0), (left, up, corner)))[y % 5]
            lines.append(bytes([y % 5]) + ((pixels[y] - guess) & 255).astype(np.uint8).tobytes())
        head = f"{k + 1} 0 obj << /Subtype /Image /Width {w} /Height {h} /BitsPerComponent {8 if k != 3 else 1} /ColorSpace /Device{'Gray' if channels == 1 else 'RGB'} /Filter /FlateDecode /DecodeParms << /Predictor 15 >> >>\nstream\n"
        out.append(head.encode() + zlib.compress(b"".join(lines)) + b"\nendstream\nendobj\n")
    return b"".join(out)


@query
def pdf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image candidates of a document made of each page's html."""
    content = F.udf(text_document, "binary")  # makes the input; the operator takes any documents
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.substring(F.coalesce("html", F.lit("")), 1, 400), "[^A-Za-z0-9<>/.]", "_").alias("payload"))
    documents = pages.select("doc_id", content("doc_id", "payload").alias("content"))
    return pdf_images.candidates(pdf_images.extract_images(documents)).select("doc_id", "image", "width", "height", "channels", F.md5("pixels").alias("pixels_md5"), "pos")
