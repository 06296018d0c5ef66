"""Registered queries over records, patches, tickets' writes, accounts and lookups, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, strings
from larkspur.operators import permissions, records, tickets, users
from larkspur.operators.ordering import with_position
from larkspur.plans.catalogue import held_users
from larkspur.sources.views import duckdb_ctes, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


K = records.EMPLOYEE_KEYS


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees with their JSON objects: slash dates, times, numbers of milliseconds, nulls, missing keys and no object at all."""
    k = F.col("id")
    day = F.when(k % 5 == 0, F.date_format("iq_exp", "M/d/yyyy")).when(k % 5 == 1, F.concat(F.col("iq_exp").cast("string"), F.lit("T10:00:00Z"))).when(k % 5 == 2, "soon").otherwise(F.col("iq_exp").cast("string"))
    entries = F.to_json(F.create_map(F.lit(K["eid"]), "eid", F.lit(K["name"]), "name", F.lit(K["iqama"]), "iqama", F.lit(K["iq_exp"]), day))
    millis = (F.unix_date("lic_exp").cast("long") * 86_400_000 + 3_600_000).cast("string")
    licence = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(f', "{K["lic_exp"]}": '), millis)).when(k % 4 == 2, f', "{K["lic_exp"]}": null').otherwise(F.concat(F.lit(f', "{K["lic_exp"]}": "'), F.col("lic_exp").cast("string"), F.lit('"')))
    data = F.concat(F.regexp_replace(entries, "}$", ""), licence, F.lit("}"))
    return view(spark, sf_dir, "employees").select("id", "eid", "iqama", "name", F.when(k % 11 == 0, "no object").otherwise(data).alias("data"))


@query(f"""{duckdb_ctes("employees")} SELECT id, CASE WHEN id % 11 != 0 THEN eid END AS eid, CASE WHEN id % 11 != 0 THEN name END AS name, CASE WHEN id % 11 != 0 THEN iqama END AS iqama,
CASE WHEN id % 11 != 0 AND id % 5 != 2 THEN CAST(iq_exp AS VARCHAR) END AS iq_exp, CASE WHEN id % 11 != 0 AND id % 4 IN (1, 3) THEN CAST(lic_exp AS VARCHAR) END AS lic_exp FROM employees""")
def employee_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees' typed records out of their JSON."""
    rows = records.employee_records(_json(spark, sf_dir))
    return rows.select("id", "eid", "name", "iqama", F.col("iq_exp").cast("string").alias("iq_exp"), F.col("lic_exp").cast("string").alias("lic_exp"))


@query(f"""{duckdb_ctes("employees")} SELECT eid, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'N' || id ELSE iqama END AS iqama, name, CASE WHEN id % 3 = 1 THEN 'X' || id ELSE eid END AS key_eid,
CASE WHEN id % 3 = 2 THEN 2 ELSE 3 END AS entries, 'employee' AS kind FROM employees
UNION ALL SELECT 'gone' || id, NULL, NULL, NULL, NULL, 'no such employee' FROM employees WHERE id % 10 = 0""")
def employee_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees after overlays of their JSON, and the patches that meet none."""
    e, k = view(spark, sf_dir, "employees"), F.col("id")
    base = e.select("id", "eid", "iqama", "name", F.create_map(F.lit(K["eid"]), "eid", F.lit(K["name"]), "name").alias("data"))
    none = F.lit(None).cast("string")
    new = F.when(k % 3 == 0, F.create_map(F.lit(K["iqama"]), none)).otherwise(F.create_map(F.lit(K["iqama"]), F.concat(F.lit("N"), k.cast("string")), F.lit(K["eid"]), F.concat(F.lit("X"), k.cast("string"))))
    patch = e.where(k % 3 != 2).select("eid", new.alias("data")).unionAll(e.where(k % 10 == 0).select(F.concat(F.lit("gone"), k.cast("string")), F.create_map(F.lit("a"), F.lit("b"))))
    after, missing = records.update_employees(base, patch)
    rows = after.select("eid", "iqama", "name", F.try_element_at("data", F.lit(K["eid"])).alias("key_eid"), F.size("data").alias("entries"), F.lit("employee").alias("kind"))
    return rows.unionAll(missing.select("eid", none, none, none, F.lit(None).cast("int"), F.lit("no such employee")))


@query(f"""{duckdb_ctes("permits")}, p AS (SELECT id, iqama, 'P ' || id || '/(x)*~é' AS permit, CASE id % 4 WHEN 0 THEN 'https://q/' || id WHEN 1 THEN '' END AS url, CASE id % 3 WHEN 0 THEN 'text' WHEN 1 THEN '' END AS text FROM permits)
SELECT permit, iqama, coalesce(nullif(url, ''), CASE WHEN nullif(text, '') IS NOT NULL THEN '/api/files/qr?permit=P%20' || id || '%2F(x)*~%C3%A9' END) AS qr, nullif(text, '') AS qr_text,
nullif(url, '') IS NULL AND nullif(text, '') IS NOT NULL AS qr_auto, permit AS decoded FROM p""")
def permit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permits with the address of their code, stored or drawn."""
    k = F.col("id")
    rows = view(spark, sf_dir, "permits").select(F.concat(F.lit("P "), k.cast("string"), F.lit("/(x)*~é")).alias("permit_no"), "iqama", F.when(k % 4 == 0, F.concat(F.lit("https://q/"), k.cast("string"))).when(k % 4 == 1, "").alias("qr_url"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "").alias("qr_text"))
    return records.permit_records(rows).withColumn("decoded", strings.uri_decode(strings.uri_encode(F.col("permit"))))


@query(f"""{duckdb_ctes("employees", "ticket_events")},
r AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE 'm' END AS month_label, CASE WHEN id % 4 = 0 AND id % 8 = 0 THEN NULL WHEN id % 4 = 0 THEN 'u' || id ELSE 'f' || id END AS file_url, 'f' || id AS old FROM employees),
a AS (SELECT ticket_id, id, 'k' || id AS key, kind, CASE WHEN id % 2 = 0 THEN 'a' || id END AS old, id = 0 AND ticket_id % 2 = 0 AS hit FROM ticket_events WHERE ticket_id IN (SELECT id FROM employees)),
n AS (SELECT DISTINCT ticket_id FROM a WHERE ticket_id % 3 = 0)
SELECT 'run' AS kind, CAST(id AS VARCHAR) AS id, NULL AS key, month_label AS label, file_url FROM r
UNION ALL SELECT 'attachment', CAST(ticket_id AS VARCHAR), key, kind, CASE WHEN hit THEN 'n' ELSE old END FROM a
UNION ALL SELECT 'attachment', CAST(ticket_id AS VARCHAR), 'extra', NULL, 'x' FROM n
UNION ALL SELECT 'delete', CAST(id AS VARCHAR), NULL, NULL, old FROM r WHERE file_url IS DISTINCT FROM old
UNION ALL SELECT 'delete', CAST(ticket_id AS VARCHAR), key, NULL, old FROM a WHERE hit AND old IS NOT NULL""")
def payroll_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and attachments after partial updates, and the files to delete."""
    k, no, text = F.col("id"), F.lit(False), lambda c: F.lit(c).cast("string")
    runs = view(spark, sf_dir, "employees").select("id", F.lit("m").alias("month_label"), F.lit("s").alias("status_key"), F.concat(F.lit("f"), k.cast("string")).alias("file_url"))
    run_patch = runs.where(k % 4 == 0).select("id", F.lit(True).alias("has_month_label"), F.lit("new").alias("new_month_label"), no.alias("has_status_key"), text(None).alias("new_status_key"), F.lit(True).alias("has_file_url"), F.when(k % 8 != 0, F.concat(F.lit("u"), k.cast("string"))).alias("new_file_url"))
    parts = view(spark, sf_dir, "ticket_events").join(runs.select(k.alias("ticket_id")), "ticket_id", "left_semi")
    parts = parts.select(F.col("ticket_id").alias("run_id"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.col("kind").alias("label"), text("s").alias("status_key"), F.when(k % 2 == 0, F.concat(F.lit("a"), k.cast("string"))).alias("file_url"), text(None).alias("note"))
    given = lambda key, url, rows: rows.select("run_id", F.lit(key).alias("key"), *[x for f in records.ATTACHMENT_FIELDS for x in (F.lit(f == "file_url").alias(f"has_{f}"), text(url if f == "file_url" else "?").alias(f"new_{f}"))])
    patch = given("k0", "n", parts.where("key = 'k0' and run_id % 2 = 0")).unionByName(given("extra", "x", parts.where("run_id % 3 = 0").select("run_id").distinct())).unionByName(given("k0", "n", spark.range(1).select(F.lit(-5).cast("long").alias("run_id"))))
    runs, parts, gone = records.update_runs(runs, parts, run_patch, patch)
    rows = runs.select(F.lit("run").alias("kind"), F.col("id").cast("string").alias("id"), text(None).alias("key"), F.col("month_label").alias("label"), "file_url")
    rows = rows.unionAll(parts.select(F.lit("attachment"), F.col("run_id").cast("string"), "key", "label", "file_url"))
    return rows.unionAll(gone.select(F.lit("delete"), F.col("run_id").cast("string"), "key", text(None), "url"))


@query(f"""{duckdb_ctes("tickets", "employees")},
i AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE 'T' || id END AS title, CASE WHEN id % 9 = 0 THEN NULL ELSE 'other' END AS type FROM tickets),
o AS (SELECT i.*, e.iqama, CASE WHEN title IS NULL THEN 'no_title' WHEN type IS NULL THEN 'unknown_type' WHEN i.employee_eid IS NOT NULL AND e.eid IS NULL THEN 'no_such_employee' ELSE 'created' END AS outcome FROM i LEFT JOIN employees e ON i.employee_eid = e.eid),
n AS (SELECT id, printf('TKT-%d-%04d', year(opened_at), row_number() OVER (PARTITION BY year(opened_at) ORDER BY opened_at, id) + CASE year(opened_at) WHEN 2024 THEN 9990 ELSE 0 END) AS ticket_no FROM o WHERE outcome = 'created')
SELECT o.id, o.outcome, n.ticket_no, o.title, CASE WHEN o.id % 4 = 0 THEN 'normal' ELSE o.priority END AS priority, o.status, '{tickets.COUNTERPARTY}' AS counterparty, o.employee_eid, o.iqama, CASE WHEN o.id % 2 = 0 THEN CAST(o.follow_up_date AS VARCHAR) END AS follow_up_date
FROM o LEFT JOIN n ON o.id = n.id""")
def ticket_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of requests for tickets."""
    k = F.col("id")
    inputs = view(spark, sf_dir, "tickets").select(
        "id", "opened_at", F.when(k % 7 == 0, " \t").otherwise(F.concat(F.lit("  T"), k.cast("string"))).alias("title"), F.when(k % 9 == 0, "nonsense").otherwise("other").alias("type"),
        F.when(k % 4 == 0, "nonsense").otherwise(F.col("priority")).alias("priority"), "status", F.lit("").alias("counterparty"), F.concat(F.lit(" "), "employee_eid").alias("employee_eid"),
        F.col("assignee_id").cast("string").alias("assignee_id"), F.when(k % 2 == 0, F.col("follow_up_date").cast("string")).otherwise("tomorrow").alias("follow_up_date"),
    )
    last = spark.createDataFrame([(2024, 9990)], "year int, last_seq long")
    rows = tickets.created(inputs, view(spark, sf_dir, "employees"), last)
    return rows.select("id", "outcome", "ticket_no", "title", "priority", "status", "counterparty", "employee_eid", F.col("employee_iqama_at_creation").alias("iqama"), "follow_up_date")


def _patch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, old = F.col("id"), view(spark, sf_dir, "tickets")
    status = F.when(k % 3 == 0, "completed").when(k % 3 == 1, "open").otherwise("nonsense")
    return old, old.where(k % 5 != 0).select("id", status.alias("status"), (k % 7 != 0).alias("has_status"), F.lit(None).cast("date").alias("follow_up_date"), (k % 2 == 0).alias("has_follow_up_date"))


_AFTER = f"""{duckdb_ctes("tickets")}, u AS (SELECT *, id % 5 != 0 AND NOT (id % 7 != 0 AND id % 3 = 2) AS ok FROM tickets),
v AS (SELECT *, CASE WHEN ok AND id % 7 != 0 THEN CASE id % 3 WHEN 0 THEN 'completed' ELSE 'open' END ELSE status END AS s, CASE WHEN ok AND id % 2 = 0 THEN NULL ELSE follow_up_date END AS f, status IN ('completed', 'cancelled') AS was FROM u)"""


@query(f"""{_AFTER} SELECT id, s AS status, priority, assignee_id, CAST(f AS VARCHAR) AS follow_up_date,
strftime(CASE WHEN NOT ok THEN closed_at WHEN s IN ('completed', 'cancelled') AND NOT was THEN TIMESTAMP '2024-02-03 04:05:06' WHEN was AND s NOT IN ('completed', 'cancelled') THEN NULL ELSE closed_at END, '%Y-%m-%d %H:%M:%S') AS closed_at FROM v""")
def ticket_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickets after a patch that gives some fields of some of them."""
    rows = tickets.updated(*_patch(spark, sf_dir), at="2024-02-03 04:05:06")
    return rows.select("id", "status", "priority", "assignee_id", F.col("follow_up_date").cast("string").alias("follow_up_date"), F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed_at"))


@query(f"""{_AFTER}, w AS (SELECT *, s IN ('completed', 'cancelled') AS now FROM v WHERE ok)
SELECT id AS ticket_id, CAST(0 AS INT) AS seq, 'status_changed' AS kind, status AS from_value, s AS to_value FROM w WHERE s != status
UNION ALL SELECT id, 3, 'follow_up_date_changed', CAST(follow_up_date AS VARCHAR), NULL FROM w WHERE f IS DISTINCT FROM follow_up_date
UNION ALL SELECT id, 100, 'closed', NULL, s FROM w WHERE now AND NOT was UNION ALL SELECT id, 101, 'reopened', status, s FROM w WHERE was AND NOT now""")
def partial_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of that patch."""
    return tickets.change_events(*_patch(spark, sf_dir))


@query(f"""{duckdb_ctes("tickets")} SELECT id, CASE WHEN id % 6 = 0 THEN 'no_such_ticket' WHEN id % 4 = 0 THEN 'no_text' WHEN id % 5 = 0 THEN 'unknown_status' ELSE 'added' END AS outcome,
CASE WHEN id % 6 = 0 THEN -id ELSE id END AS ticket_id, 'followup' AS kind, CASE WHEN id % 4 != 0 THEN 'call ' || id END AS body FROM tickets WHERE id > 0""")
def ticket_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of notes on tickets."""
    k, all_ = F.col("id"), view(spark, sf_dir, "tickets")
    body = F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" call "), k.cast("string")))
    notes = all_.where("id > 0").select("id", F.when(k % 6 == 0, -k).otherwise(k).alias("ticket_id"), F.col("opened_at").alias("at"), body.alias("body"), (k % 5 == 0).alias("has_status"), F.lit("nonsense").alias("new_status"))
    return tickets.followed_up(all_, notes).select("id", "outcome", "ticket_id", "kind", "body")


@query(f"""{duckdb_ctes("tickets", "employees", "permits")}, n AS (SELECT id, printf('TKT-%d-%04d', year(opened_at), row_number() OVER (PARTITION BY year(opened_at) ORDER BY opened_at, id)) AS ticket_no FROM tickets)
SELECT 'employee' AS kind, id, eid AS key FROM employees WHERE eid = 'E7' UNION ALL SELECT 'permit', id, permit_no FROM permits WHERE permit_no = 'P12'
UNION ALL SELECT 'ticket by id', id, ticket_no FROM n WHERE id = 17 UNION ALL SELECT 'ticket by number', id, ticket_no FROM n WHERE ticket_no = 'TKT-2024-0003'""")
def record_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An employee, a permit, and tickets by id and by number."""
    numbered = tickets.numbered(view(spark, sf_dir, "tickets"))
    rows = records.lookup(view(spark, sf_dir, "employees"), "eid", "E7").select(F.lit("employee").alias("kind"), "id", F.col("eid").alias("key"))
    rows = rows.unionAll(records.lookup(view(spark, sf_dir, "permits"), "permit_no", "P12").select(F.lit("permit"), "id", "permit_no"))
    for kind, key in (("ticket by id", "17"), ("ticket by number", "TKT-2024-0003")):
        rows = rows.unionAll(records.ticket_lookup(numbered, key).select(F.lit(kind), "id", "ticket_no"))
    return rows


@query(f"{duckdb_ctes('tickets')} SELECT id, row_number() OVER (ORDER BY id DESC) AS pos FROM tickets")
def tickets_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets from the newest id on."""
    return with_position(view(spark, sf_dir, "tickets").select("id"), F.col("id").desc())


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    created = F.when(k % 10 != 0, F.timestamp_add("DAY", (k * 37) % 100, F.lit("2020-01-01").cast("timestamp_ntz")))
    return view(spark, sf_dir, "users").select(F.concat(F.lit("u"), k.cast("string")).alias("id"), "name", F.concat(F.lit("User."), k.cast("string"), F.lit("@Example.org")).alias("email"), F.lit("hash").alias("password_hash"), "role", created.alias("created_at"))


_ACCOUNTS = f"""{duckdb_ctes("users")}, accounts AS (SELECT 'u' || id AS id, name, 'User.' || id || '@Example.org' AS email, role, CASE WHEN id % 10 != 0 THEN TIMESTAMP '2020-01-01' + to_days(CAST((id * 37) % 100 AS INT)) END AS created_at FROM users)"""
#: Accounts that are there even if the table hasn't them; the second isn't set up.
FALLBACK = [("u3", "Fallback", "other@example.org", "hash", "owner", None), None, ("env", "Fallback", "Env@example.org", "hash", "owner", None)]


@query(f"{_ACCOUNTS} SELECT id, name, email, role, row_number() OVER (ORDER BY created_at NULLS LAST, id) AS pos FROM accounts")
def users_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts without secrets, in the order of their creation."""
    rows = users.public(_accounts(spark, sf_dir))
    assert not set(users.SECRETS) & set(rows.columns)
    return with_position(rows, F.col("created_at").asc_nulls_last(), F.col("id").asc()).select("id", "name", "email", "role", "pos")


@query(f"""{_ACCOUNTS} SELECT 'USER.3@example.ORG' AS wanted, id, name FROM accounts WHERE id = 'u3' UNION ALL VALUES ('env@EXAMPLE.org', 'env', 'Fallback'), ('env', 'env', 'Fallback')
UNION ALL SELECT 'u3', id, name FROM accounts WHERE id = 'u3' UNION ALL VALUES ('taken', 'true', NULL), ('free', 'false', NULL)""")
def user_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by address and by id, of the table or else of the fallbacks, and whether two are taken."""
    all_ = _accounts(spark, sf_dir)
    rows = None
    for find, wanted in ((users.by_email, "USER.3@example.ORG"), (users.by_email, "env@EXAMPLE.org"), (users.by_email, "nobody@x"), (users.by_id, "env"), (users.by_id, "u3")):
        some = find(all_, wanted, FALLBACK).select(F.lit(wanted).alias("wanted"), "id", "name")
        rows = some if rows is None else rows.unionAll(some)
    probes = [("taken", str(users.taken(all_, "zzz", "user.1@EXAMPLE.org")).lower(), None), ("free", str(users.taken(all_, "zzz", "zzz")).lower(), None)]
    return rows.unionAll(spark.createDataFrame(probes, "wanted string, id string, name string"))


_HAS = lambda p: f"(a.role = 'owner' OR list_contains(a.held, '{p}'))"


def _held_sql() -> str:
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    roles = " ".join(f"WHEN '{r}' THEN {quoted(h)}" for r, h in permissions.ROLES.items())
    return f"""{duckdb_ctes("users")}, h AS (SELECT id, role, CASE WHEN role = 'owner' OR perm_mode = 0 THEN CASE role {roles} END WHEN perm_mode = 1 THEN ['kpi:view', 'tickets:view', 'users:manage'] ELSE []::VARCHAR[] END AS held FROM users),
pairs AS (SELECT a.id, a.role, a.held, t.id AS target_id, t.role AS target_role, CASE (a.id + t.id) % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'nobody' WHEN 2 THEN t.role ELSE '' END AS wanted FROM h a JOIN h t ON t.id BETWEEN a.id AND a.id + 5)"""


HELD_PAIRS = _held_sql()


@query(f"""{HELD_PAIRS} SELECT id, target_id,
CASE WHEN NOT {_HAS("users:create")} THEN 'not_allowed' WHEN wanted = '' THEN 'missing_field' WHEN wanted = 'nobody' THEN 'unknown_role' WHEN a.role != 'owner' AND wanted = 'owner' THEN 'owner_only' END AS creates,
CASE WHEN NOT {_HAS("users:edit")} AND NOT {_HAS("users:manage")} THEN 'not_allowed' WHEN a.role != 'owner' AND target_role = 'owner' THEN 'target_is_owner' WHEN wanted = 'nobody' THEN 'unknown_role'
  WHEN wanted = 'owner' AND target_role != 'owner' AND a.role != 'owner' THEN 'owner_only' WHEN NOT {_HAS("users:edit")} THEN 'not_allowed' END AS edits,
CASE WHEN NOT {_HAS("users:delete")} THEN 'not_allowed' WHEN id = target_id THEN 'own_account' WHEN a.role != 'owner' AND target_role = 'owner' THEN 'target_is_owner' END AS deletes,
{_HAS("users:edit").replace("a.role = 'owner' OR ", "")} OR list_contains(a.held, 'users:manage') AS any_of FROM pairs a""")
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against each user's creating, editing and deleting accounts like those of the next few."""
    actors = held_users(spark, sf_dir).select("id", "role", "held")
    target = actors.select(F.col("id").alias("target_id"), F.col("role").alias("target_role"))
    # the next few by an equality, not by a range
    near = actors.withColumn("target_id", F.explode(F.sequence(F.col("id"), F.col("id") + 5)))
    rows = near.join(target, "target_id")
    n = (F.col("id") + F.col("target_id")) % 4
    rows = rows.withColumn("wanted", F.when(n == 0, "owner").when(n == 1, "nobody").when(n == 2, F.col("target_role")).otherwise(""))
    role, held, wanted = F.col("role"), F.col("held"), F.col("wanted")
    return rows.select(
        "id", "target_id",
        users.create_verdict(role, held, F.lit("n"), F.lit("e"), wanted).alias("creates"),
        users.edit_verdict(role, held, F.col("target_role"), wanted, F.lit(True)).alias("edits"),
        users.delete_verdict(role, held, F.col("id"), F.col("target_id"), F.col("target_role")).alias("deletes"),
        users.has_any(held, ["users:edit", "users:manage"]).alias("any_of"),
    )


_SECTIONS = ["employees", "tickets", "nowhere"]


@query(f"""{HELD_PAIRS}, s AS (SELECT unnest({_SECTIONS}) AS section), t AS (SELECT unnest(['upload', 'delete', 'qr']) AS action)
SELECT a.id, section, action, CASE WHEN action = 'qr' THEN 'unknown_action' WHEN section != 'employees' THEN 'no_files_in_section' WHEN a.role != 'owner' AND NOT list_contains(a.held, section || ':' || action || '_files') THEN 'not_allowed' END AS verdict FROM h a, s, t""")
def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against each user's actions on files."""
    rows = held_users(spark, sf_dir).select("id", "role", "held", F.explode(F.array(*map(F.lit, _SECTIONS))).alias("section"))
    rows = rows.withColumn("action", F.explode(F.array(*map(F.lit, ["upload", "delete", "qr"]))))
    return rows.select("id", "section", "action", users.file_verdict(F.col("role"), F.col("held"), F.col("section"), F.col("action")).alias("verdict"))


@query(f"""{duckdb_ctes("tickets")} SELECT id, CASE WHEN id % 4 = 0 THEN '—' ELSE day(opened_at) || ' ' || ['{"', '".join(dates.MONTHS)}'][month(opened_at)] || ' ' || strftime(opened_at, '%H:%M') END AS at,
CASE WHEN id % 5 = 0 THEN '—' WHEN priority = 'high' THEN 'High' ELSE priority END AS label FROM tickets""")
def ticket_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and labels as they are shown."""
    k, at = F.col("id"), F.col("opened_at")
    label = strings.label_of(F.when(k % 10 == 0, "").when(k % 5 != 0, F.col("priority")), {"high": "High"})
    return view(spark, sf_dir, "tickets").select("id", dates.date_time_text(F.when(k % 4 != 0, at)).alias("at"), label.alias("label"))


@query(r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN page_id % 3 = 0 THEN 'no_pdf' WHEN page_id % 4 = 1 THEN 'no_pdf' END AS verdict FROM pages""")
def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against uploads made of pages: empty ones, and such as only say that they are PDFs."""
    from larkspur.sources.views import table

    k = F.col("page_id")
    content = F.when(k % 5 == 0, "").when((k % 3 == 1) & (k % 4 != 1), F.concat(F.lit("%PDF-1.4 "), "url")).otherwise(F.coalesce("url", F.lit("x"))).cast("binary")
    kind, name = F.when(k % 3 == 0, "application/PDF").otherwise("text/html"), F.when((k % 4 == 1) | (k % 3 == 1), "a.PDF").otherwise("a.html")
    return table(spark, sf_dir, "pages").select("page_id", users.upload_verdict(content, kind, name).alias("verdict"))


@query("""SELECT event_id, event_type AS type, CASE WHEN event_id % 3 != 0 THEN 'a' || user_id END AS actor_id, CASE WHEN event_id % 2 = 0 THEN '{"k":1}' ELSE '{}' END AS meta FROM events""")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of half the events with the other half appended."""
    from larkspur.sources.views import table

    k, none = F.col("event_id"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(k.cast("string").alias("ts"), F.col("event_type").alias("type"), F.lit("").alias("actor_email"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("a"), F.col("user_id").cast("string"))).alias("actor_id"), F.lit("").alias("target_id"), F.when(k % 2 == 0, '{"k":1}').alias("meta"))
    empty = rows.limit(0)
    log = users.append_audit(users.append_audit(empty, rows.where("cast(ts as long) % 2 = 0")), rows.where("cast(ts as long) % 2 = 1"))
    return log.select(F.col("ts").cast("long").alias("event_id"), "type", "actor_id", "meta")
