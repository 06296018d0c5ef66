"""DuckDB SQL for the registered queries over the workforce tables."""

from __future__ import annotations

from larkspur.operators.permissions import ALL, ROLES
from larkspur.operators.tickets import STATUSES
from larkspur.sources.views import AS_OF, TODAY, duckdb_ctes

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iqama ORDER BY coalesce(issue_date, DATE '1970-01-01') DESC, id) AS rn FROM permits) WHERE rn = 1)"""
ALERTS = f"""{duckdb_ctes("employees", "permits", "document_types")}, {_LATEST},
crossed AS (SELECT e.id AS employee_id, e.name AS employee_name, d.key AS type_key, d.label AS type_label, d.sort_order,
  CASE d.employee_field WHEN 'iqExp' THEN e.iq_exp WHEN 'licExp' THEN e.lic_exp WHEN 'ajeerExp' THEN l.expiry_date END AS expiry
  FROM employees e LEFT JOIN latest l ON e.iqama = l.iqama CROSS JOIN document_types d),
alerts AS (SELECT * FROM (SELECT *, CAST(date_diff('day', DATE '{AS_OF}', expiry) AS INT) AS remaining_days,
  CASE WHEN expiry < DATE '{AS_OF}' THEN 'overdue' ELSE CASE date_diff('day', DATE '{AS_OF}', expiry) WHEN 0 THEN 'today' WHEN 2 THEN '2day' WHEN 5 THEN '5day' END END AS stage
  FROM crossed) WHERE stage IS NOT NULL)"""
_OVERDUE = f"CASE WHEN status NOT IN ('completed', 'cancelled') AND follow_up_date < DATE '{TODAY}' THEN date_diff('day', follow_up_date, DATE '{TODAY}') ELSE 0 END"
_LIST = f"""{duckdb_ctes("tickets", "employees", "users")}, listed AS (SELECT t.id, t.employee_eid, e.eid IS NOT NULL AS employee_exists,
  CASE WHEN e.eid IS NOT NULL THEN e.iqama ELSE t.employee_iqama_at_creation END AS iqama, e.name AS employee_name, nullif(u.name, '') AS assignee_name,
  t.status, t.status IN ('completed', 'cancelled') AS is_closed FROM tickets t LEFT JOIN employees e ON t.employee_eid = e.eid LEFT JOIN users u ON t.assignee_id = u.id)"""


def _array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_CATALOGUE = f"catalogue AS (SELECT unnest({_array(ALL)}) AS permission, unnest(range({len(ALL)})) AS place)"
ROLES_CTE = "roles AS (" + " UNION ALL ".join(f"SELECT '{r}' AS role, unnest({_array(h)}) AS permission, unnest(range({len(h)})) AS place" for r, h in ROLES.items()) + ")"
_HELD = f"""{duckdb_ctes("users")}, {_CATALOGUE}, {ROLES_CTE},
held AS (SELECT u.id, u.role, c.permission, c.place FROM users u, catalogue c WHERE u.role = 'owner'
  OR (u.perm_mode = 1 AND c.permission IN ('tickets:view', 'gone:view', 'users:manage', 'kpi:view'))
  UNION ALL SELECT u.id, u.role, r.permission, r.place FROM users u JOIN roles r ON r.role = u.role WHERE u.perm_mode = 0 AND u.role != 'owner')"""
CLAUSE = "CASE stage WHEN 'overdue' THEN 'منتهية منذ ' || abs(remaining_days) || ' يوم' WHEN 'today' THEN 'تنتهي اليوم' ELSE 'متبقي ' || remaining_days || ' أيام' END"
_NEXT = """next AS (SELECT id, CASE WHEN status = 'open' THEN 'completed' WHEN status = 'cancelled' THEN 'in_progress' WHEN priority = 'high' THEN 'nonsense' ELSE status END AS status, priority,
  CASE WHEN priority = 'medium' THEN assignee_id + 1 ELSE assignee_id END AS assignee_id, CASE WHEN priority = 'urgent' THEN NULL ELSE follow_up_date END AS follow_up_date,
  CASE WHEN status = 'awaiting_us' THEN employee_eid || 'x' ELSE employee_eid END AS employee_eid FROM tickets),
both_ AS (SELECT t.id, t.status AS s0, n.status AS s1, CAST(t.assignee_id AS VARCHAR) AS a0, CAST(n.assignee_id AS VARCHAR) AS a1, CAST(t.follow_up_date AS VARCHAR) AS f0, CAST(n.follow_up_date AS VARCHAR) AS f1,
  t.employee_eid AS e0, n.employee_eid AS e1 FROM tickets t JOIN next n ON t.id = n.id WHERE n.status != 'nonsense')"""

ORACLES: dict[str, str] = {
    "expiry_scan": f"{ALERTS} SELECT employee_id, employee_name, type_label, CAST(expiry AS VARCHAR) AS expiry, remaining_days, stage FROM alerts",
    "latest_permit": f"{duckdb_ctes('permits')}, {_LATEST} SELECT iqama, id, permit_no, CAST(issue_date AS VARCHAR) AS issue_date, CAST(expiry_date AS VARCHAR) AS expiry_date FROM latest",
    "date_parse_cases": """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 12 AS k FROM orders),
p AS (SELECT *, CAST(year(d) AS VARCHAR) AS y, CAST(month(d) AS VARCHAR) AS m, CAST(day(d) AS VARCHAR) AS t FROM o)
SELECT id, CASE k WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(d AS VARCHAR) WHEN 3 THEN y || '-' || m || '-' || t WHEN 4 THEN m || '/' || t || '/' || y WHEN 5 THEN (month(d) + 12) || '/' || t || '/' || y WHEN 6 THEN m || '/' || (day(d) + 31) || '/' || y
  WHEN 7 THEN m || '/' || t || '/' || right(y, 2) WHEN 8 THEN CAST(d AS VARCHAR) || 'T10:00:00Z' WHEN 9 THEN y || '-' || m WHEN 10 THEN y || '-' || (month(d) + 12) || '-01' ELSE CAST(d AS VARCHAR) || ' 10:00' END AS text,
CAST(CASE k WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN d WHEN 5 THEN make_date(year(d) + 1, month(d), 1) + CAST(day(d) - 1 AS INT) WHEN 6 THEN make_date(year(d), month(d), 1) + CAST(day(d) + 30 AS INT)
  WHEN 7 THEN make_date(1900 + year(d) % 100, month(d), 1) + CAST(day(d) - 1 AS INT) WHEN 8 THEN d WHEN 9 THEN make_date(year(d), month(d), 1) END AS VARCHAR) AS parsed FROM p""",
    "alert_mails": f"""{ALERTS}, placed AS (SELECT *, row_number() OVER (ORDER BY employee_id, sort_order, type_key) AS pos FROM alerts),
lines AS (SELECT pos, pos || '. ' || employee_name || ' — ' || type_label || ' — ' || {CLAUSE} || CASE stage WHEN 'overdue' THEN ' ⚠️ يتطلب إجراءً فوريًا' ELSE '' END AS line FROM placed)
SELECT r.email, '🔔 تنبيه بقرب انتهاء وثيقة موظف' AS subject, 'batch' AS kind, l.pos, CASE WHEN r.ok THEN l.line END AS line, CASE WHEN NOT r.ok THEN 'no template for ' || r.email END AS error
FROM lines l, (VALUES ('first@example.org', true), ('second@example.org', false)) AS r(email, ok)""",
    "ticket_list": f"{_LIST} SELECT * FROM listed",
    "ticket_by_employee": f"{_LIST} SELECT *, row_number() OVER (ORDER BY id DESC) AS pos FROM listed WHERE employee_eid = 'E7'",
    "ticket_timeline": f"{duckdb_ctes('ticket_events')} SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY id) AS INT) AS pos, kind, body FROM ticket_events",
    "ticket_summary": f"""{duckdb_ctes("tickets")} SELECT count(*) FILTER (status NOT IN ('completed', 'cancelled')) AS open, count(*) FILTER (status = 'awaiting_counterparty') AS awaiting_counterparty,
count(*) FILTER (status = 'awaiting_us') AS awaiting_us, count(*) FILTER ({_OVERDUE} > 0) AS overdue, count(*) FILTER (status = 'completed' AND strftime(closed_at, '%Y-%m') = '{TODAY[:7]}') AS completed_this_month FROM tickets""",
    "ticket_attention": f"""{duckdb_ctes("tickets")}, r AS (SELECT id, follow_up_date, CAST({_OVERDUE} AS INT) AS overdue, CAST(CASE WHEN {_OVERDUE} > 0 THEN 0 WHEN priority = 'urgent' THEN 1
  WHEN status NOT IN ('completed', 'cancelled') AND follow_up_date = DATE '{TODAY}' THEN 2 ELSE 3 END AS INT) AS rank FROM tickets)
SELECT id, rank, overdue, row_number() OVER (ORDER BY rank, overdue DESC, coalesce(follow_up_date, DATE '9999-12-31'), id DESC) AS pos FROM r""",
    "payroll_nested": f"""{duckdb_ctes("ticket_events")} SELECT ticket_id AS run_id, dense_rank() OVER (ORDER BY ticket_id DESC) AS place, CAST(count(*) OVER (PARTITION BY ticket_id) AS INT) AS n,
CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY id) - 1 AS INT) AS pos, kind AS key, body AS note FROM ticket_events""",
    "settings_map": "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation",
    "audit_tail": """SELECT event_id AS id, event_type AS type, CASE WHEN event_id % 3 != 0 THEN 'u' || user_id || '@example.org' END AS actor_email, 'u' || user_id AS actor_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS target_id, props AS meta,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(row_number() OVER (ORDER BY events.ts DESC, event_id DESC) AS INT) AS pos FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 200""",
    "pdf_candidates": r"""WITH p AS (SELECT page_id AS doc_id, regexp_replace(left(coalesce(html, ''), 400), '[^A-Za-z0-9<>/.]', '_', 'g') AS payload FROM pages),
i AS (SELECT doc_id, payload, k, CAST(2 + (doc_id + 3 * k) % 9 AS INT) AS width, CAST(2 + (doc_id * 7 + k) % 9 AS INT) AS height, CASE WHEN (doc_id + k) % 2 = 1 THEN 1 ELSE 3 END AS channels FROM (SELECT *, unnest(range(1 + doc_id % 5)) AS k FROM p)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS image FROM i WHERE k != 3)
SELECT doc_id, image, width, height, channels, md5(rpad(left(payload, width * height * channels), width * height * channels, '.')) AS pixels_md5,
CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs(width / height - 1), width * height, image) AS INT) AS pos FROM r QUALIFY pos <= 8""",
    "doc_types_sorted": "SELECT lower(n_name) AS key, n_name AS label, CAST(row_number() OVER (ORDER BY n_nationkey % 4, lower(n_name)) AS INT) AS pos FROM nation",
    "user_permissions": f"""{_HELD} SELECT h.id, h.role, h.role = 'owner' OR u.perm_mode = 0 AS defaults, CAST(row_number() OVER (PARTITION BY h.id ORDER BY place) - 1 AS INT) AS pos, permission FROM held h JOIN users u ON h.id = u.id""",
    "permission_escalation": f"""{_HELD}, wanted AS (SELECT permission, place FROM catalogue WHERE permission IN ('settings:edit', 'kpi:view', 'users:view')),
more AS (SELECT u.id, string_agg(w.permission, ', ' ORDER BY w.place) AS more FROM users u, wanted w WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.id = u.id AND h.permission = w.permission) GROUP BY u.id)
SELECT u.id, t.id AS target_id, CASE WHEN u.role != 'owner' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.id = u.id AND h.permission = 'users:manage') THEN 'not_allowed'
  WHEN t.role = 'owner' THEN 'target_is_owner' WHEN t.id = u.id THEN 'own_account' WHEN u.role != 'owner' AND m.more IS NOT NULL THEN 'escalation: ' || m.more END AS verdict
FROM users u JOIN users t ON u.id + 1 = t.id LEFT JOIN more m ON m.id = u.id""",
    "ticket_status_gate": f"""{_HELD}, {duckdb_ctes("tickets").removeprefix("WITH ")}, statuses AS (SELECT unnest({_array(STATUSES)}) AS wanted)
SELECT t.id, s.wanted, u.role = 'owner' OR EXISTS (SELECT 1 FROM held h WHERE h.id = u.id AND h.permission =
  CASE WHEN t.status IN ('completed', 'cancelled') OR s.wanted IN ('completed', 'cancelled') THEN 'tickets:close' ELSE 'tickets:edit' END) AS allowed
FROM tickets t JOIN users u ON t.assignee_id = u.id, statuses s""",
    "insert_if_absent": """WITH o AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderstatus AS value FROM orders)
SELECT *, 'kept' AS outcome FROM o WHERE value = 'F' UNION ALL
SELECT key, seq, value, CASE WHEN rn = 1 AND key NOT IN (SELECT key FROM o WHERE value = 'F') THEN 'inserted' ELSE 'rejected' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM o WHERE value != 'F')""",
    "upsert_replace": """SELECT coalesce(c_custkey, s_suppkey) AS key, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS name,
CASE WHEN s_suppkey IS NOT NULL THEN NULL ELSE c_acctbal END AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
    "json_merge": """SELECT event_id, 'k' AS key, CASE event_type WHEN 'purchase' THEN 'patched' ELSE json_extract_string(props, '$.k') END AS value FROM events
UNION ALL SELECT event_id, 'u', CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase'""",
    "change_events": f"""{duckdb_ctes("tickets")}, {_NEXT}
SELECT id AS ticket_id, CAST(0 AS INT) AS seq, 'status_changed' AS kind, s0 AS from_value, s1 AS to_value FROM both_ WHERE s0 != s1
UNION ALL SELECT id, 2, 'assignee_changed', a0, a1 FROM both_ WHERE a0 IS DISTINCT FROM a1
UNION ALL SELECT id, 3, 'follow_up_date_changed', f0, f1 FROM both_ WHERE f0 IS DISTINCT FROM f1
UNION ALL SELECT id, 10, 'edited', 'employee_eid', e1 FROM both_ WHERE e0 IS DISTINCT FROM e1
UNION ALL SELECT id, 100, 'closed', NULL, s1 FROM both_ WHERE s1 IN ('completed', 'cancelled') AND s0 NOT IN ('completed', 'cancelled')
UNION ALL SELECT id, 101, 'reopened', s0, s1 FROM both_ WHERE s0 IN ('completed', 'cancelled') AND s1 NOT IN ('completed', 'cancelled')""",
    "ticket_numbers": f"""{duckdb_ctes("tickets")}, n AS (SELECT id, CAST(year(opened_at) AS INT) AS year, row_number() OVER (PARTITION BY year(opened_at) ORDER BY opened_at, id) AS seq FROM tickets)
SELECT id, year, seq, printf('TKT-%d-%04d', year, seq) AS ticket_no FROM n""",
    "delete_cascade": f"""{duckdb_ctes("tickets", "ticket_events")} SELECT 'ticket' AS kind, id, CAST(NULL AS BIGINT) AS turn FROM tickets WHERE status != 'cancelled'
UNION ALL SELECT 'event', ticket_id, id FROM ticket_events e WHERE NOT EXISTS (SELECT 1 FROM tickets t WHERE t.id = e.ticket_id AND t.status = 'cancelled')""",
    "expiry_verdict": f"""{duckdb_ctes("employees")},
x AS (SELECT CASE WHEN id % 17 = 0 THEN 'X' || eid ELSE eid END AS eid, CASE WHEN id % 19 = 0 THEN 'passport' WHEN id % 2 = 0 THEN 'iqama' ELSE 'work_license' END AS doc_type,
  CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '2001/08/01' WHEN id % 3 = 0 THEN CAST(iq_exp AS VARCHAR) WHEN id % 3 = 1 THEN '2001-08-03' ELSE '2002-01-31' END AS gregorian,
  id % 5 = 0 AS has_hijri, CASE WHEN id % 23 = 0 THEN '001' WHEN id % 4 = 0 THEN iqama ELSE '' END AS doc_digits, id % 6 != 0 AS has_file FROM employees),
j AS (SELECT x.*, e.eid IS NOT NULL AS known, e.iqama, CASE doc_type WHEN 'iqama' THEN CASE WHEN e.id % 7 = 0 THEN 'soon' ELSE CAST(e.iq_exp AS VARCHAR) END WHEN 'work_license' THEN CAST(e.lic_exp AS VARCHAR) END AS previous
  FROM x LEFT JOIN employees e ON x.eid = e.eid),
v AS (SELECT *, CASE WHEN doc_type = 'passport' THEN 'unknown_document_type' WHEN NOT known THEN 'employee_not_found' WHEN doc_digits != '' AND doc_digits != iqama THEN 'identity_mismatch'
  WHEN gregorian IS NULL OR contains(gregorian, '/') THEN 'no_date' WHEN previous = 'soon' OR previous IS NULL THEN 'set' WHEN gregorian < previous THEN 'older_than_current' WHEN gregorian = previous THEN 'unchanged' ELSE 'updated' END AS reason FROM j)
SELECT eid, doc_type, previous, reason, reason IN ('updated', 'set') AS applied, has_file AND reason NOT IN ('unknown_document_type', 'employee_not_found') AS attach_file, has_hijri AND reason IN ('updated', 'set', 'unchanged') AS set_hijri FROM v""",
    "permit_qr_update": f"""{duckdb_ctes("permits")},
b AS (SELECT id, permit_no, CASE WHEN id % 4 != 0 THEN 'https://f/' || permit_no END AS f, CASE WHEN id % 3 = 0 THEN 'https://q/' || permit_no END AS q, CASE WHEN id % 5 = 0 THEN 'old text' END AS t,
  id % 10 != 9 AND id % 2 = 0 AS hf, id % 10 != 9 AND id % 3 = 0 AS hq, id % 10 != 9 AND id % 7 = 0 AS ht FROM permits),
n AS (SELECT *, CASE WHEN hf THEN CASE WHEN id % 8 != 0 THEN 'https://f/new' END ELSE f END AS nf, CASE WHEN ht THEN CASE WHEN id % 14 = 0 THEN 'new text' END ELSE t END AS nt FROM b),
m AS (SELECT *, CASE WHEN ht AND nt IS NOT NULL THEN NULL WHEN hq THEN CASE WHEN id % 9 = 0 THEN 'HTTPS://q/new' END ELSE q END AS nq FROM n)
SELECT permit_no, nf AS file_url, nq AS qr_url, CASE WHEN NOT (hf AND nf IS NULL) THEN nt END AS qr_text,
  concat_ws(' ', CASE WHEN hf AND f IS DISTINCT FROM nf THEN f END, CASE WHEN q IS DISTINCT FROM nq THEN q END) AS superseded FROM m""",
    "text_clean": r"""SELECT page_id, nullif(left(trim(url), 20), '') AS cleaned, regexp_replace(url, '[^0-9]', '', 'g') AS digits, regexp_replace(url, '[^A-Za-z0-9_.\-\x{0600}-\x{06FF}]', '_', 'g') AS file,
regexp_replace(url, '[^A-Za-z0-9_\-/]', '', 'g') AS prefix, replace(replace(replace(replace('<a href="' || url || '">&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
coalesce(regexp_matches(url, '^https?://', 'i'), false) AS is_url FROM pages""",
}
