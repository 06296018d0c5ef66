"""Registered queries over letters, codes in documents, typed JSON, change sets, deletes and permission specs, and their DuckDB SQL."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, strings
from larkspur.operators import letters, mutations, nested, pdf_images, permissions, records, tickets, users
from larkspur.operators.ordering import with_position
from larkspur.plans.catalogue import alerts, held_users
from larkspur.plans.oracles import ALERTS, CLAUSE, ROLES_CTE
from larkspur.plans.records import HELD_PAIRS
from larkspur.sources.views import TODAY, duckdb_ctes, table, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _text(value: str | None):
    return F.lit(value).cast("string")


_MORE = duckdb_ctes("readers").removeprefix("WITH ")


@query(f"""{ALERTS}, {_MORE}, placed AS (SELECT *, row_number() OVER (ORDER BY employee_id, sort_order, type_key) AS pos FROM alerts),
lines AS (SELECT pos, CAST((pos - 1) // {letters.MOST_LINES} AS INT) AS part, pos || '. ' || employee_name || ' — ' || type_label || ' — ' || {CLAUSE} || CASE stage WHEN 'overdue' THEN ' ⚠️ يتطلب إجراءً فوريًا' ELSE '' END AS line FROM placed),
parts AS (SELECT part, string_agg(line, chr(10) ORDER BY pos) AS lines FROM lines GROUP BY part),
n AS (SELECT count(*) AS n FROM placed)
SELECT email, 'batch' AS kind, part + 1 AS part, n AS n_alerts, 'For ' || name || ' {{' || chr(10) || n || ' of them:' || chr(10) || lines || chr(10) || '{{unknown}} end' AS body FROM readers, parts, n WHERE id != 3
UNION ALL SELECT email, 'reject', NULL, NULL, 'no template for ' || email FROM readers WHERE id = 3""")
def alert_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters about all alerts, one for each reader, and the reader who has no template."""
    rows = with_position(alerts(spark, sf_dir), F.col("employee_id").asc(), F.col("sort_order").asc(), F.col("type_key").asc())
    readers = view(spark, sf_dir, "readers")
    batch = F.concat(F.lit("For "), "name", F.lit(" {\n{count} of them:\n{lines}\n{unknown} end"))
    templates = readers.where("id != 3").select("email", F.lit("{employee}").alias("single"), batch.alias("batch"), _text(None).alias("warning"), _text(None).alias("haste_late"), _text(None).alias("haste_ahead"))
    made, rejects = letters.alert_letters(rows, readers, templates)
    made = made.select("email", "kind", "part", "n_alerts", "body")
    return made.unionAll(rejects.select("email", F.lit("reject"), F.lit(None).cast("int"), F.lit(None).cast("long"), "error"))


@query(f"""{ALERTS}, {_MORE}, first AS (SELECT * FROM alerts ORDER BY employee_id, sort_order, type_key LIMIT 1)
SELECT email, 'single' AS kind, employee_name || ' ' || CASE stage WHEN 'overdue' THEN 'منتهية' ELSE 'ستنتهي' END || ' ' || type_label || ' ' || CASE stage WHEN 'overdue' THEN 'منذ ' || abs(remaining_days) || ' يوم' WHEN 'today' THEN 'اليوم' ELSE 'بعد ' || remaining_days || ' أيام' END
  || chr(10) || day(expiry) || ' ' || ['{"', '".join(dates.MONTHS)}'][month(expiry)] || ' ' || year(expiry) || chr(10) || {CLAUSE} || chr(10) || CASE stage WHEN 'overdue' THEN 'Late, ' || name || '! now' ELSE ' soon' END AS body FROM first, readers""")
def first_alert_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters about the first alert alone, in full words."""
    rows = with_position(alerts(spark, sf_dir), F.col("employee_id").asc(), F.col("sort_order").asc(), F.col("type_key").asc()).where("pos = 1")
    readers = view(spark, sf_dir, "readers")
    single = F.lit("{employee} {state} {document} {when}\n{expiry}\n{remaining}\n{warning} {haste}")
    templates = readers.select("email", single.alias("single"), F.lit("{lines}").alias("batch"), F.concat(F.lit("Late, "), "name", F.lit("!")).alias("warning"), F.lit("now").alias("haste_late"), F.lit("soon").alias("haste_ahead"))
    return letters.alert_letters(rows, readers, templates)[0].select("email", "kind", "body")


#: The byte before the text in an image that page_document() draws, and that decode_marked() looks for.
MARK = b"\x81"


def page_document(page_id: int, payload: str) -> bytes:
    """A PDF of a page: a banner, maybe a small square without a text, a square with the payload, and a larger square with another text."""
    images = [(8, 2, b"")]
    if page_id % 3 == 0:
        images.append((2, 2, b""))
    text = MARK + payload.encode() if page_id % 5 and payload else b""
    side = max(3, math.isqrt(len(text)) + 1)
    images.append((side, side, text))
    if page_id % 7 == 0:
        images.append((side + 1, side + 1, MARK + b"other"))
    out = [b"%PDF-1.4\n" if page_id % 11 else b"no pdf\n"]
    for k, (w, h, data) in enumerate(images):
        raw = data.ljust(w * h, b"\0")
        rows = b"".join(b"\0" + raw[y * w : (y + 1) * w] for y in range(h))
        head = f"{k + 1} 0 obj << /Subtype /Image /Width {w} /Height {h} /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode /DecodeParms << /Predictor 15 >> >>\nstream\n"
        out.append(head.encode() + zlib.compress(rows) + b"\nendstream\nendobj\n")
    return b"".join(out)


def decode_marked(rgba: bytes, width: int, height: int) -> str | None:
    """A decoder for page_document(): the text after the mark, in the red bytes."""
    gray = rgba[::4]
    return gray[1:].rstrip(b"\0").decode() if gray[:1] == MARK else None


@query(r"""WITH p AS (SELECT page_id, regexp_replace(left(coalesce(html, ''), 60), '[^A-Za-z0-9<>/.]', '_', 'g') AS payload FROM pages),
q AS (SELECT *, page_id % 5 != 0 AND payload != '' AS marked, page_id % 3 = 0 AS small, page_id % 7 = 0 AS large FROM p)
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 0 WHEN marked THEN 1 + CAST(small AS INT) WHEN large THEN 2 + CAST(small AS INT) ELSE 2 + CAST(small AS INT) END AS tried,
CASE WHEN page_id % 11 = 0 THEN NULL WHEN marked THEN 1 + CAST(small AS INT) WHEN large THEN 2 + CAST(small AS INT) END AS image,
CASE WHEN page_id % 11 = 0 THEN NULL WHEN marked THEN payload WHEN large THEN 'other' END AS text FROM q""")
def document_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text that can be read in the images of a document made of each page's html."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.substring(F.coalesce("html", F.lit("")), 1, 60), "[^A-Za-z0-9<>/.]", "_").alias("payload"))
    content = F.udf(page_document, "binary")  # makes the input; the operator takes any documents
    found = pdf_images.first_texts(pages.select("page_id", content("page_id", "payload").alias("content")), decode_marked, "page_id")
    return found.select("page_id", F.col("tried").cast("int").alias("tried"), "image", "text")


@query("""WITH e AS (SELECT event_id, user_id, event_type,
  '{"id": ' || event_id || ', "in": {"u": ' || user_id || ', "deep": {"x": null}}, "tags": ["a", ' || user_id || '], "w": ' || (event_id * 2) || '.5, "keep": "' || event_type || '"}' AS data FROM events)
SELECT event_id, CASE event_type WHEN 'purchase' THEN '{"id":' || event_id || ',"in":{"v":1.5},"keep":"purchase","new":[true,{"y":2}],"tags":["a",' || user_id || '],"w":null}' ELSE data END AS data, NULL AS reason FROM e
UNION ALL SELECT event_id, NULL, 'no object' FROM e WHERE event_type = 'view' UNION ALL SELECT -event_id, NULL, 'no such key' FROM e WHERE event_type = 'click' AND event_id > 0""")
def typed_json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON, nested, overlaid by a patch of the purchases, and what of the patch changes nothing."""
    k, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    data = F.concat(F.lit('{"id": '), k, F.lit(', "in": {"u": '), u, F.lit(', "deep": {"x": null}}, "tags": ["a", '), u, F.lit('], "w": '), (F.col("event_id") * 2).cast("string"), F.lit('.5, "keep": "'), "event_type", F.lit('"}'))
    events = table(spark, sf_dir, "events")
    base = events.select("event_id", data.alias("data"))
    patch = events.where("event_type = 'purchase'").select("event_id", F.lit('{"w": null, "in": {"v": 1.50}, "new": [true, {"y": 2}]}').alias("data"))
    patch = patch.unionAll(events.where("event_type = 'view'").select("event_id", F.lit("[1]"))).unionAll(events.where("event_type = 'click' and event_id > 0").select(-F.col("event_id"), F.lit("{}")))
    after, rejects = mutations.merge_typed_json(base, patch, "event_id", "data")
    return after.select("event_id", "data", _text(None).alias("reason")).unionAll(rejects.select("event_id", _text(None), "reason"))


#: An account that is there even if the table hasn't it: id, name, email, password_hash, role, status, job_title, permissions, created_at, last_login.
SPARE = ("spare", "Spare", "spare@example.org", "hash", "owner", "active", None, None, None, None)


@query(f"""{duckdb_ctes("users")}, a AS (SELECT 'u' || id AS id, id AS k, name, CASE WHEN id % 4 != 0 THEN 'Clerk' END AS job_title, CASE id % 3 WHEN 1 THEN 'kpi:view, users:view' WHEN 2 THEN '' END AS held FROM users)
SELECT 'account' AS kind, id, CASE WHEN k % 5 = 1 THEN 'New ' || k ELSE name END AS name, CASE WHEN k % 5 = 1 THEN CASE WHEN k % 2 = 0 THEN 'Lead' END ELSE job_title END AS job_title,
  CASE WHEN k % 5 > 2 OR k % 7 = 0 THEN held WHEN k % 7 < 3 THEN NULL WHEN k % 7 < 5 THEN 'tickets:view' ELSE '' END AS permissions FROM a
UNION ALL VALUES ('reflected', 'spare', 'Spare', 'Guest', 'kpi:view')
UNION ALL SELECT 'missing', 'x' || k, NULL, NULL, NULL FROM a WHERE k % 10 = 0""")
def account_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts after a patch of some fields of some of them, what it would make of the spare one, and ids that are nobody's."""
    k, none = F.col("id"), F.lit(None)
    held = F.when(k % 3 == 1, F.array(F.lit("kpi:view"), F.lit("users:view"))).when(k % 3 == 2, F.array().cast("array<string>"))
    base = view(spark, sf_dir, "users")
    key = F.concat(F.lit("u"), k.cast("string"))
    rows = base.select(key.alias("id"), "name", F.concat(key, F.lit("@example.org")).alias("email"), F.lit("hash").alias("password_hash"), "role", F.lit("active").alias("status"), F.when(k % 4 != 0, "Clerk").alias("job_title"), held.alias("permissions"), none.cast("timestamp").alias("created_at"), none.cast("timestamp").alias("last_login"))
    wanted = F.when(k % 7 >= 5, F.array().cast("array<string>")).when(k % 7 >= 3, F.array(F.lit("tickets:view")))
    names = (k % 5 == 1).alias("has_name"), F.concat(F.lit("New "), k.cast("string")).alias("new_name"), (k % 5 == 1).alias("has_job_title"), F.when(k % 2 == 0, "Lead").otherwise("").alias("new_job_title")
    patch = base.where(k % 5 <= 2).select(key.alias("id"), *names, (k % 7 != 0).alias("has_permissions"), wanted.alias("new_permissions"))
    nobody = base.where(k % 10 == 0).select(F.concat(F.lit("x"), k.cast("string")), *names, F.lit(True), wanted)
    spare = spark.range(1).select(F.lit("spare"), F.lit(False), _text(None), F.lit(True), F.lit("Guest"), F.lit(True), F.array(F.lit("kpi:view")))
    after, reflected, missing = users.update_users(rows, patch.unionAll(nobody).unionAll(spare), [None, SPARE])
    shown = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id", "name", "job_title", F.array_join("permissions", ", ").alias("permissions"))
    return shown("account", after).unionAll(shown("reflected", reflected)).unionAll(missing.select(F.lit("missing"), "id", _text(None), _text(None), _text(None)))


@query("""SELECT 'type' AS kind, lower(n_name) AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'New ' || n_name ELSE n_name END AS label, CAST(CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 ELSE n_regionkey END AS INT) AS sort_order FROM nation
UNION ALL SELECT 'missing type', 'no ' || lower(n_name), NULL, NULL FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'recipient', lower(r_name) || '@example.org', CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE r_name END, NULL FROM region""")
def column_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as document types and regions as recipients, after patches of some of their columns, and keys that are nobody's."""
    k, none = F.col("n_nationkey"), F.lit(None).cast("int")
    nation = table(spark, sf_dir, "nation")
    types = nation.select(F.lower("n_name").alias("key"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("int").alias("sort_order"))
    given = [(k % 3 == 0).alias("has_label"), F.concat(F.lit("New "), "n_name").alias("new_label"), (k % 2 == 0).alias("has_sort_order"), F.when(k % 4 != 0, k * 10).cast("int").alias("new_sort_order")]
    patch = nation.select(F.lower("n_name").alias("key"), *given).unionAll(nation.where(k % 5 == 0).select(F.concat(F.lit("no "), F.lower("n_name")), *given))
    after, missing = mutations.update_columns(types, patch, "key", ["label", "sort_order"])
    readers = view(spark, sf_dir, "readers").select("email", "name")
    named, _ = mutations.update_columns(readers, view(spark, sf_dir, "readers").where("id % 2 = 0").select("email", F.lit(True).alias("has_name"), _text(None).alias("new_name")), "email", ["name"])
    return after.select(F.lit("type").alias("kind"), "key", "label", "sort_order").unionAll(missing.select(F.lit("missing type"), "key", _text(None), none)).unionAll(named.select(F.lit("recipient"), "email", "name", none))


@query(f"""{duckdb_ctes("ticket_log")} SELECT ticket_id, id, CASE WHEN id % 3 = 0 THEN 'followup' ELSE 'edited' END AS kind, nullif(left(regexp_replace(body || repeat('x', 3900), '^\\s+|\\s+$', '', 'g'), 4000), '') AS body,
nullif(left(coalesce(from_value, '') || repeat('v', 150) || coalesce(to_value, '') || repeat('w', 60), 200), '') AS from_value, NULL AS to_value FROM ticket_log""")
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are appended: kinds that aren't known are edits, and long texts are cut."""
    log, none = view(spark, sf_dir, "ticket_log"), _text("")
    kind = F.when(F.col("id") % 3 == 0, "followup").otherwise(F.concat(F.lit("by "), "kind"))
    long_ = F.concat(F.coalesce("from_value", none), F.repeat(F.lit("v"), 150), F.coalesce("to_value", none), F.repeat(F.lit("w"), 60))
    return log.select("id", *tickets.event(F.col("ticket_id"), kind, F.col("at"), F.concat("body", F.repeat(F.lit("x"), 3900)), long_, F.lit(" "))).drop("at")


_AT = "TIMESTAMP '2024-03-01 00:00:00' + to_hours(CAST(j * 5 AS INT))"


@query(f"""{duckdb_ctes("ticket_table")},
notes AS (SELECT t.id * 4 + j AS id, CASE WHEN t.id % 6 = 0 AND j = 1 THEN -t.id - 1 ELSE t.id END AS ticket_id, {_AT} AS "at", CASE WHEN (t.id + j) % 7 = 0 THEN NULL ELSE 'call ' || j END AS body,
  (t.id + j) % 3 != 0 AS has_status, ['open', 'completed', 'nonsense', 'cancelled', 'in_progress'][1 + (t.id * 3 + j) % 5] AS new_status,
  (t.id + j) % 2 = 0 AS has_date, CASE WHEN (t.id + j) % 4 = 0 THEN '2025-01-0' || (1 + j) END AS new_date, t.id % 3 AS actor FROM ticket_table t, (SELECT unnest([0, 1, 2]) AS j) WHERE t.id % 2 = 0 OR j = 0),
judged AS (SELECT n.*, t.status AS t_status, CAST(t.follow_up_date AS VARCHAR) AS t_date, CASE WHEN t.id IS NULL THEN 'no_such_ticket' WHEN body IS NULL THEN 'no_text' WHEN has_status AND new_status = 'nonsense' THEN 'unknown_status' ELSE 'added' END AS outcome FROM notes n LEFT JOIN ticket_table t ON n.ticket_id = t.id),
f AS (SELECT *, coalesce(last_value(CASE WHEN has_status THEN new_status END IGNORE NULLS) OVER w, t_status) AS s0, nullif(coalesce(last_value(CASE WHEN has_date THEN coalesce(new_date, '-') END IGNORE NULLS) OVER w, t_date), '-') AS d0
  FROM judged WHERE outcome = 'added' WINDOW w AS (PARTITION BY ticket_id ORDER BY "at", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN has_status THEN new_status ELSE s0 END AS s1, CASE WHEN has_date THEN new_date ELSE d0 END AS d1 FROM f),
h AS (SELECT *, s0 IN ('completed', 'cancelled') AS was, s1 IN ('completed', 'cancelled') AS now FROM g),
last AS (SELECT ticket_id, max("at") AS noted, arg_max(s1, id) AS s, arg_max({{'d': d1}}, id).d AS d, max(CASE WHEN was != now THEN id END) AS moved, arg_max({{'c': CASE WHEN now THEN "at" END}}, id) FILTER (was != now) AS c FROM h GROUP BY ticket_id)
SELECT 'ticket' AS kind, id, CAST(NULL AS INT) AS seq, coalesce(s, status) AS a, CASE WHEN l.ticket_id IS NOT NULL THEN d ELSE CAST(follow_up_date AS VARCHAR) END AS b, strftime(CASE WHEN moved IS NOT NULL THEN c.c ELSE closed_at END, '%Y-%m-%d %H:%M:%S') AS c, strftime(noted, '%Y-%m-%d %H:%M:%S') AS d
FROM ticket_table t LEFT JOIN last l ON t.id = l.ticket_id
UNION ALL SELECT 'followup', id, 0, body, NULL, NULL, 'a' || actor FROM h
UNION ALL SELECT 'status_changed', id, 1, NULL, s0, s1, 'a' || actor FROM h WHERE s0 != s1
UNION ALL SELECT 'follow_up_date_changed', id, 2, NULL, d0, d1, 'a' || actor FROM h WHERE d0 IS DISTINCT FROM d1
UNION ALL SELECT 'closed', id, 3, NULL, NULL, s1, 'a' || actor FROM h WHERE now AND NOT was
UNION ALL SELECT 'reopened', id, 4, NULL, s0, s1, 'a' || actor FROM h WHERE was AND NOT now
UNION ALL SELECT 'reject', id, NULL, outcome, NULL, NULL, NULL FROM judged WHERE outcome != 'added'""")
def follow_up_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets after up to three notes each, the events that these make, and the notes that are refused."""
    all_, k, j = view(spark, sf_dir, "ticket_table"), F.col("id"), F.col("j")
    rows = all_.select(k.alias("t"), F.explode(F.when(k % 2 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("j"))
    t = F.col("t")
    status = F.get(F.array(*map(F.lit, ["open", "completed", "nonsense", "cancelled", "in_progress"])), ((t * 3 + j) % 5).cast("int"))
    notes = rows.select(
        (t * 4 + j).alias("id"), F.when((t % 6 == 0) & (j == 1), -t - 1).otherwise(t).alias("ticket_id"), F.timestamp_add("HOUR", j * 5, F.lit("2024-03-01 00:00:00").cast("timestamp")).alias("at"),
        F.when((t + j) % 7 == 0, " \t").otherwise(F.concat(F.lit(" call "), j.cast("string"))).alias("body"), ((t + j) % 3 != 0).alias("has_status"), status.alias("new_status"),
        ((t + j) % 2 == 0).alias("has_follow_up_date"), F.when((t + j) % 4 == 0, F.concat(F.lit("2025-01-0"), (j + 1).cast("string"))).otherwise("soon").alias("new_follow_up_date"),
        F.concat(F.lit("a"), (t % 3).cast("string")).alias("actor_id"), F.lit("Actor").alias("actor_name"), F.lit("a@example.org").alias("actor_email"),
    )
    after, events, rejects = tickets.follow_ups(all_, notes)
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    out = after.select(F.lit("ticket").alias("kind"), "id", F.lit(None).cast("int").alias("seq"), F.col("status").alias("a"), F.col("follow_up_date").cast("string").alias("b"), time("closed_at").alias("c"), time("last_followup_at").alias("d"))
    shown = F.when(F.col("kind") == "followup", F.col("body"))
    out = out.unionAll(events.select("kind", "note_id", "seq", shown, "from_value", "to_value", "actor_id"))
    return out.unionAll(rejects.select(F.lit("reject"), "id", F.lit(None).cast("int"), "outcome", _text(None), _text(None), _text(None)))


@query(f"""{duckdb_ctes("tickets", "employees")},
i AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE 'T' || id END AS title, id % 9 != 0 AS typed FROM tickets),
o AS (SELECT i.*, CASE WHEN title IS NULL THEN 'no_title' WHEN NOT typed THEN 'unknown_type' WHEN i.employee_eid IS NOT NULL AND e.eid IS NULL THEN 'no_such_employee' ELSE 'created' END AS outcome FROM i LEFT JOIN employees e ON i.employee_eid = e.eid),
n AS (SELECT id, title, printf('TKT-%d-%04d', year(opened_at), row_number() OVER (PARTITION BY year(opened_at) ORDER BY opened_at, id)) AS ticket_no FROM o WHERE outcome = 'created')
SELECT 'ticket' AS kind, id, ticket_no AS a, title AS b FROM n UNION ALL SELECT 'created', id, ticket_no, 'a' || id % 3 FROM n UNION ALL SELECT 'reject', id, outcome, NULL FROM o WHERE outcome != 'created'""")
def creation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets made of requests, the event of each, and the requests that are refused."""
    k = F.col("id")
    inputs = view(spark, sf_dir, "tickets").select(
        "id", "opened_at", F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.when(k % 9 == 0, "nonsense").otherwise("other").alias("type"), "priority", "status",
        F.lit(None).cast("string").alias("counterparty"), "employee_eid", F.col("assignee_id").cast("string").alias("assignee_id"), F.lit(None).cast("string").alias("follow_up_date"),
        F.concat(F.lit("a"), (k % 3).cast("string")).alias("actor_id"), F.lit("Actor").alias("actor_name"), F.lit("a@example.org").alias("actor_email"),
    )
    made, events, rejects = tickets.creation(inputs, view(spark, sf_dir, "employees"))
    out = made.select(F.lit("ticket").alias("kind"), "id", F.col("ticket_no").alias("a"), F.col("title").alias("b"))
    return out.unionAll(events.select("kind", "ticket_id", "to_value", "actor_id")).unionAll(rejects.select(F.lit("reject"), "id", "outcome", _text(None)))


@query(f"""{duckdb_ctes("employees", "ticket_events")},
r AS (SELECT id, CASE WHEN id % 4 != 0 THEN 'f' || id % 50 END AS file_url FROM employees), a AS (SELECT ticket_id AS run_id, id, CASE WHEN id % 3 = 0 THEN '' ELSE 'a' || ticket_id || '-' || id % 2 END AS file_url FROM ticket_events),
gone AS (SELECT id FROM r WHERE id % 3 = 0), freed AS (SELECT id, file_url FROM r WHERE id IN (SELECT id FROM gone) UNION SELECT run_id, file_url FROM a WHERE run_id IN (SELECT id FROM gone)),
still AS (SELECT file_url FROM r WHERE id NOT IN (SELECT id FROM gone) AND file_url IS NOT NULL UNION SELECT file_url FROM a WHERE run_id NOT IN (SELECT id FROM gone))
SELECT 'run' AS kind, id, file_url AS a FROM r WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'attachment', run_id, file_url FROM a WHERE run_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'outcome', id, 'deleted' FROM gone UNION ALL SELECT 'outcome', -id, 'missing' FROM gone WHERE id > 0
UNION ALL SELECT 'freed', id, file_url FROM freed WHERE file_url != '' AND file_url NOT IN (SELECT file_url FROM still)""")
def run_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and attachments after deletes, of keys that are there and of others, and the files that these free."""
    k = F.col("id")
    runs = view(spark, sf_dir, "employees").select("id", F.when(k % 4 != 0, F.concat(F.lit("f"), (k % 50).cast("string"))).alias("file_url"))
    parts = view(spark, sf_dir, "ticket_events").select(F.col("ticket_id").alias("run_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("a"), F.col("ticket_id").cast("string"), F.lit("-"), (k % 2).cast("string"))).alias("file_url"))
    asked = runs.where(k % 3 == 0).select("id")
    rest, others, outcomes, freed = mutations.delete_keys(runs, parts, asked.unionAll(asked).unionAll(asked.where("id > 0").select(-k)), "id", "run_id")
    out = rest.select(F.lit("run").alias("kind"), "id", F.col("file_url").alias("a")).unionAll(others.select(F.lit("attachment"), "run_id", "file_url"))
    return out.unionAll(outcomes.select(F.lit("outcome"), "id", "outcome")).unionAll(freed.select(F.lit("freed"), "id", "file"))


def _specs(spark: SparkSession) -> DataFrame:
    rows = [(role, at, section, actions) for role, spec in permissions.ROLE_SPECS.items() for at, (section, actions) in enumerate([("*", None)] if spec == "*" else [*spec.items(), ("gone", ["view"]), ("kpi", ["delete"])])]
    return spark.createDataFrame(rows, "role string, at int, section string, actions array<string>")


@query(f"""{duckdb_ctes("users")}, {ROLES_CTE} SELECT u.id, u.role, CAST(row_number() OVER (PARTITION BY u.id ORDER BY place) - 1 AS INT) AS pos, permission FROM users u JOIN roles r ON u.role = r.role""")
def role_spec_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all users' roles give them, by specs in which a section or an action may be unknown."""
    held = permissions.role_defaults(permissions.expand_specs(_specs(spark), permissions.catalogue(spark)))
    return view(spark, sf_dir, "users").join(F.broadcast(held), "role").select("id", "role", F.posexplode("permissions").alias("pos", "permission"))


_SECTIONS, _VERBS = [*permissions.CATALOGUE, "nowhere"], ["GET", "post", "PUT", "DELETE", "PATCH"]


@query(f"""{HELD_PAIRS}, s AS (SELECT unnest({_SECTIONS}) AS section), v AS (SELECT unnest({_VERBS}) AS verb, unnest(['view', 'create', 'edit', 'delete', NULL]) AS action)
SELECT h.id, section, verb, CASE WHEN section = 'nowhere' THEN 'no_such_section' WHEN action IS NULL THEN 'no_such_verb' WHEN h.role != 'owner' AND NOT list_contains(h.held, section || ':' || action) THEN 'not_allowed' END AS verdict FROM h, s, v""")
def request_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against each user's requests on every section."""
    rows = held_users(spark, sf_dir).select("id", "role", "held", F.explode(F.array(*map(F.lit, _SECTIONS))).alias("section"))
    rows = rows.withColumn("verb", F.explode(F.array(*map(F.lit, _VERBS))))
    return rows.select("id", "section", "verb", permissions.request_verdict(F.col("role"), F.col("held"), F.col("section"), F.col("verb")).alias("verdict"))


_WANTED = ["null", '["kpi:view", "stale:one", 7]', '{"kpi": true}', '"kpi:view"', "nonsense", "[]"]
_CASES = ", ".join(f"({k}, '{w}', {'true' if w[0] in '[n' and w != 'nonsense' else 'false'}, {'true' if 'kpi:view' in w and w[0] == '[' else 'false'})" for k, w in enumerate(_WANTED))


@query(f"""{HELD_PAIRS}, c AS (SELECT * FROM (VALUES {_CASES}, (6, NULL, true, false)) AS t(k, asked, shaped, kpi))
SELECT a.id, t.id AS target_id, c.k AS k, CASE WHEN a.role != 'owner' AND NOT list_contains(a.held, 'users:manage') THEN 'not_allowed' WHEN t.role = 'owner' THEN 'target_is_owner' WHEN a.id = t.id THEN 'own_account'
  WHEN NOT shaped THEN 'invalid_shape' WHEN a.role != 'owner' AND kpi AND NOT list_contains(a.held, 'kpi:view') THEN 'escalation: kpi:view' END AS verdict FROM h a JOIN h t ON t.id BETWEEN a.id AND a.id + 1, c""")
def permission_change_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against each user's giving themselves and the next one permissions, asked for in texts of any shape."""
    actors = held_users(spark, sf_dir).select("id", "role", "held")
    target = actors.select(F.col("id").alias("target_id"), F.col("role").alias("target_role"))
    rows = actors.withColumn("target_id", F.explode(F.array(F.col("id"), F.col("id") + 1))).join(target, "target_id")
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, _WANTED), _text(None))).alias("k", "asked"))
    wanted, shaped = permissions.wanted_permissions(F.col("asked"))
    verdict = permissions.change_verdict(F.col("role"), F.col("held"), F.col("id"), F.col("target_role"), F.col("target_id"), wanted, shaped)
    return rows.select("id", "target_id", "k", verdict.alias("verdict"))


@query(f"""{duckdb_ctes("ticket_table", "ticket_log", "employees", "users")},
e AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY "at" NULLS LAST, id) - 1 AS pos, count(*) OVER (PARTITION BY ticket_id) AS n FROM ticket_log)
SELECT CAST(t.id AS VARCHAR) AS id, t.ticket_no, t.title, t.description, t.type, t.priority, t.status, t.counterparty, t.employee_eid, t.employee_iqama_at_creation, t.created_by_id, t.created_by_name, t.assignee_id,
  strftime(t.opened_at, '%Y-%m-%d %H:%M:%S') AS opened_at, strftime(t.last_followup_at, '%Y-%m-%d %H:%M:%S') AS last_followup_at, CAST(t.follow_up_date AS VARCHAR) AS follow_up_date, strftime(t.closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at, t.notes,
  t.status IN ('completed', 'cancelled') AS is_closed, m.eid IS NOT NULL AS employee_exists, m.name AS employee_name, CASE WHEN m.eid IS NOT NULL THEN m.iqama ELSE t.employee_iqama_at_creation END AS iqama, nullif(u.name, '') AS assignee_name,
  CAST(coalesce(e.n, 0) AS INT) AS n_events, CAST(e.pos AS INT) AS pos, CAST(e.id AS VARCHAR) AS event_id, e.kind, e.body, e.from_value, e.to_value, e.actor_id, e.actor_name, strftime(e."at", '%Y-%m-%d %H:%M:%S') AS "at"
FROM ticket_table t LEFT JOIN employees m ON t.employee_eid = m.eid LEFT JOIN users u ON t.assignee_id = u.id LEFT JOIN e ON t.id = e.ticket_id""")
def ticket_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is shown of tickets, with their events nested in order, and shown flat."""
    rows = tickets.ticket_records(*(view(spark, sf_dir, v) for v in ("ticket_table", "employees", "users")))
    log = view(spark, sf_dir, "ticket_log").withColumn("ticket_id", F.col("ticket_id").cast("string"))
    nested_ = tickets.with_events(rows, log).withColumn("n_events", F.size("events"))
    flat = nested_.select("*", F.posexplode_outer("events").alias("pos", "e")).drop("events")
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    columns = [time(c).alias(c) if c.endswith("_at") else F.col(c) for c in nested_.columns if c != "events"]
    return flat.select(*columns, "pos", F.col("e.id").alias("event_id"), *[time(f"e.{c}").alias(c) if c == "at" else F.col(f"e.{c}") for c in tickets.EVENT_FIELDS])


_LATE = "CASE WHEN status NOT IN ('completed', 'cancelled') AND follow_up_date < DATE '2024-01-20' THEN date_diff('day', follow_up_date, DATE '2024-01-20') ELSE 0 END"


@query(f"""{duckdb_ctes("tickets")}, t AS (SELECT *, {_LATE} AS n FROM tickets)
SELECT id, coalesce(day(follow_up_date) || ' ' || ['{"', '".join(dates.MONTHS)}'][month(follow_up_date)] || ' ' || year(follow_up_date), '—') AS day,
CASE WHEN n > 0 THEN 'متأخرة ' || n || ' ' || CASE WHEN n = 1 THEN 'يوم' WHEN n = 2 THEN 'يومان' WHEN n <= 10 THEN 'أيام' ELSE 'يومًا' END
  WHEN status NOT IN ('completed', 'cancelled') AND follow_up_date = DATE '2024-01-20' THEN 'متابعة اليوم' ELSE '' END AS badge FROM t""")
def ticket_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The follow-up dates of all tickets in words, and whether they are overdue or due."""
    rows = view(spark, sf_dir, "tickets")
    return rows.select("id", dates.long_date(F.col("follow_up_date")).alias("day"), tickets.due_badge(TODAY).alias("badge"))


@query(f"{duckdb_ctes('employees')} SELECT id, eid, row_number() OVER (ORDER BY id) AS pos FROM employees")
def employees_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees by their ids, as they are listed."""
    return with_position(view(spark, sf_dir, "employees").select("id", "eid"), F.col("id").asc())


@query("""SELECT doc_id, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS digits_md5, md5(regexp_replace(text, '[^A-Za-z0-9_.\\-\\x{0600}-\\x{06FF}]', '_', 'g')) AS file_md5,
md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5, CASE WHEN text != '' THEN '"qr-' || left(sha1(text), 16) || '"' END AS tag FROM documents""")
def document_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules and image tags over the whole texts of all documents."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strings.digits(text)).alias("digits_md5"), F.md5(strings.safe_filename(text)).alias("file_md5"), F.md5(strings.escape_html(text)).alias("escaped_md5"), records.code_tag(text).alias("tag"))


@query(f"""{duckdb_ctes("permits")} SELECT 'mapped' AS kind, permit_no AS a, '/api/files/qr?permit=' || permit_no AS b FROM permits WHERE permit_no = 'P12' UNION ALL SELECT 'raw', permit_no, 'text' FROM permits WHERE permit_no = 'P12'
UNION ALL SELECT 'setting', n_name, CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)""")
def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permit as it is shown and as it is stored, a setting, and a ticket of a number that no id can have."""
    permits = view(spark, sf_dir, "permits").select("permit_no", "iqama", _text("").alias("qr_url"), F.lit("text").alias("qr_text"))
    rows = records.permit_lookup(permits, "P12").select(F.lit("mapped").alias("kind"), F.col("permit").alias("a"), F.col("qr").alias("b"))
    rows = rows.unionAll(records.permit_lookup(permits, "P12", mapped=False).select(F.lit("raw"), "permit_no", "qr_text"))
    settings = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    name = settings.agg(F.min("key")).first()[0]
    rows = rows.unionAll(nested.setting(settings, "key", "value", name).select(F.lit("setting"), F.lit(name), "value"))
    return rows.unionAll(records.ticket_lookup(view(spark, sf_dir, "ticket_table"), "9" * 20).select(F.lit("ticket"), F.col("id").cast("string"), "ticket_no"))
