"""Letters, decoding, typed JSON, change sets, deletes and permission specs on literal cases."""

import json
import zlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larkspur.operators import hijri, joins, letters, mutations, nested, pdf_images, permissions, records, tickets, users
from larkspur.operators.joins import spread
from larkspur.plans.changes import MARK, decode_marked, page_document

ALERT = "pos long, employee_name string, type_label string, stage string, remaining_days int, expiry date"
TEMPLATE = "email string, single string, batch string, warning string, haste_late string, haste_ahead string"


def _people(spark, *emails):
    return spark.createDataFrame([(e,) for e in emails], "email string")


def test_letters_about_one_alert(spark):
    single = "{employee}|{document}|{state}|{when}|{expiry}|{remaining}|{warning}|{haste}|{other}|{"
    templates = spark.createDataFrame([("a@x", single, "-", "late!", "now", "soon"), ("b@x", None, "-", None, None, None)], TEMPLATE)
    for stage, days, want in (
        ("overdue", -3, "{warning} N|T|منتهية|منذ 3 يوم|2 يناير 2025|منتهية منذ 3 يوم|late!|now|{other}|{"),
        ("today", 0, "{warning} N|T|ستنتهي|اليوم|2 يناير 2025|تنتهي اليوم||soon|{other}|{"),
        ("5day", 5, "{warning} N|T|ستنتهي|بعد 5 أيام|2 يناير 2025|متبقي 5 أيام||soon|{other}|{"),
    ):
        alert = spark.createDataFrame([(1, "{warning} N", "T", stage, days, date(2025, 1, 2))], ALERT)
        made, rejects = letters.alert_letters(alert, _people(spark, "a@x", "c@x", "a@x", None), templates)
        assert [(r.email, r.kind, r.part, r.parts, r.n_alerts, r.body) for r in made.collect()] == [("a@x", "single", 1, 1, 1, want)]
        assert [tuple(r) for r in rejects.collect()] == [("c@x", "no template for c@x")]
        made, _ = letters.alert_letters(alert, _people(spark, "b@x"), templates)
        assert made.first().body is None


def test_letters_keep_all_lines_in_order_and_in_parts(spark):
    rows = [(k, f"N{k}", "T", "today", 0, date(2025, 1, 2)) for k in range(1, 26)]
    alerts = spark.createDataFrame(rows[::-1], ALERT).repartition(5)
    templates = spark.createDataFrame([("a@x", "-", "{count}:\n{lines}", None, None, None)], TEMPLATE)
    lines = [f"{k}. N{k} — T — تنتهي اليوم" for k in range(1, 26)]
    made, _ = letters.alert_letters(alerts, _people(spark, "a@x"), templates)
    assert [r.body for r in made.collect()] == ["25:\n" + "\n".join(lines)]
    made, _ = letters.alert_letters(alerts, _people(spark, "a@x"), templates, most_lines=10)
    assert [(r.part, r.parts, r.body) for r in made.orderBy("part").collect()] == [(k + 1, 3, "25:\n" + "\n".join(lines[10 * k : 10 * k + 10])) for k in range(3)]
    made, rejects = letters.alert_letters(alerts.limit(0), _people(spark, "a@x", "b@x"), templates)
    assert made.collect() == [] == rejects.collect()
    with pytest.raises(Exception, match="several rows of a patch"):
        letters.alert_letters(alerts, _people(spark, "a@x"), templates.unionAll(templates))[0].collect()


def test_the_first_text_ends_the_search(spark):
    documents = spark.createDataFrame([(k, page_document(k, "text")) for k in (1, 3, 5, 7, 11, 35, 210)] + [(2, None), (4, b"%PDF-"), (6, page_document(1, "  padded ")), (None, page_document(1, "of none"))], "doc_id long, content binary")
    got = {r.doc_id: (r.tried, r.image, r.text) for r in pdf_images.first_texts(documents, decode_marked).collect()}
    assert got == {1: (1, 1, "text"), 3: (2, 2, "text"), 5: (2, None, None), 7: (1, 1, "text"), 11: (0, None, None), 35: (2, 2, "other"), 210: (3, 3, "other"), 2: (0, None, None), 4: (0, None, None), 6: (1, 1, "padded"), None: (0, None, None)}
    tried = pdf_images.attempts(documents.where("doc_id = 3"), decode_marked).orderBy("pos").collect()
    assert [(r.pos, r.image, r.text) for r in tried] == [(1, 1, None), (2, 2, "text")]


def test_a_decoder_that_fails_leaves_the_document_without_a_text(spark):
    def decode(rgba, width, height):
        if width == 2:
            raise ValueError("no")
        return "x" * 5000

    documents = spark.createDataFrame([(3, page_document(3, "text")), (4, page_document(4, "text"))], "doc_id long, content binary")
    got = {r.doc_id: (r.tried, r.text, r.error) for r in pdf_images.first_texts(documents, decode).collect()}
    assert got == {3: (1, None, "ValueError: no"), 4: (1, "x" * 4096, None)}
    assert len(MARK) == 1 and zlib.crc32(page_document(8, "t")) == zlib.crc32(page_document(8, "t"))


def test_typed_json_keeps_types(spark):
    base = spark.createDataFrame([(1, '{"n": 1.50, "s": "1", "in": {"a": [1, null, {"b": false}]}, "big": 12345678901234567890}'), (2, None), (3, "[1]"), (4, "broken"), (5, '{"same":  1}')], "k long, j string")
    patch = spark.createDataFrame([(1, '{"in": {"c": 1}, "s": null, "t": true}'), (2, '{"a": {"b": []}}'), (3, "{}"), (4, '{"x": 0}'), (9, "{}"), (5, "7"), (None, "{}")], "k long, j string")
    after, rejects = mutations.merge_typed_json(base, patch, "k", "j")
    got = {r.k: r.j for r in after.collect()}
    assert got[5] == '{"same":  1}' and {k: json.loads(t) for k, t in got.items() if k != 5} == {1: {"n": 1.5, "s": None, "in": {"c": 1}, "big": 12345678901234567890, "t": True}, 2: {"a": {"b": []}}, 3: {}, 4: {"x": 0}}
    assert list(json.loads(got[1])) == sorted(json.loads(got[1]))
    assert {(r.k, r.reason) for r in rejects.collect()} == {(9, "no such key"), (5, "no object"), (None, "no such key")}
    with pytest.raises(Exception, match="several rows of a patch"):
        mutations.merge_typed_json(base, patch.unionAll(patch), "k", "j")[0].collect()
    assert mutations.merge_typed_json(base.limit(0), patch.limit(0), "k", "j")[0].collect() == []


USER = "id string, name string, email string, password_hash string, role string, status string, job_title string, permissions array<string>, created_at timestamp, last_login timestamp"


def _user(id_, permissions=None, **more):
    row = {"id": id_, "name": "N", "email": "e", "password_hash": "h", "role": "hr", "status": "active", "job_title": "J", "permissions": permissions, "created_at": None, "last_login": None} | more
    return tuple(row.values())


def test_account_updates_have_three_states_of_permissions(spark):
    held = ["kpi:view"]
    table = spark.createDataFrame([_user(x, held) for x in ("keep", "reset", "none", "new", "both")], USER)
    patch = [("keep", False, ["x"], True, ""), ("reset", True, None, False, "?"), ("none", True, [], None, "?"), ("new", True, ["users:view"], True, "Lead"), ("both", True, ["a"], False, None), ("spare", True, ["b"], True, "Lead"), ("nobody", True, None, True, "x")]
    frame = spark.createDataFrame(patch, "id string, has_permissions boolean, new_permissions array<string>, has_job_title boolean, new_job_title string")
    after, shown, missing = users.update_users(table, frame, [None, _user("spare", None), _user("both", None, name="Other")])
    got = {r.id: (r.permissions, r.job_title) for r in after.collect()}
    assert got == {"keep": (held, None), "reset": (None, "J"), "none": ([], "J"), "new": (["users:view"], "Lead"), "both": (["a"], "J")}
    assert [(r.id, r.permissions, r.job_title) for r in shown.collect()] == [("spare", ["b"], "Lead")] and "password_hash" not in shown.columns
    assert [r.id for r in missing.collect()] == ["nobody"]
    defaults = after.select("id", permissions.uses_defaults(F.col("role"), F.col("permissions")).alias("d"))
    assert {r.id for r in defaults.where("d").collect()} == {"reset"}
    assert users.update_users(table, frame.limit(0))[0].count() == 5 and users.update_users(table.limit(0), frame)[0].collect() == []
    with pytest.raises(Exception, match="several rows of a patch"):
        users.update_users(table, frame.unionAll(frame))[0].collect()


def test_column_updates_keep_what_is_not_given(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "key string, label string, sort_order int")
    patch = spark.createDataFrame([("a", True, None), ("c", True, 7)], "key string, has_sort_order boolean, new_sort_order int")
    after, missing = mutations.update_columns(base, patch, "key", ["label", "sort_order"])
    assert sorted(map(tuple, after.collect())) == [("a", "x", None), ("b", "y", 2)] and [r.key for r in missing.collect()] == ["c"]


def test_the_calendar_is_checked():
    with pytest.raises(RuntimeError, match="not Umm al-Qura"):
        hijri.checked(list(range(0, 29 * (hijri.MONTHS + 1), 29)))


def test_every_day_of_the_calendar(spark):
    starts = hijri.month_starts(spark)
    days = spark.range(starts[0] - 2, starts[-1] + 2).select(F.date_from_unix_date(F.col("id").cast("int")).alias("day"))
    rows = hijri.to_gregorian(hijri.to_hijri(days, "day"), "hijri").select(F.unix_date("day").alias("n"), "hijri", F.unix_date("gregorian").alias("back")).collect()
    want, k = {}, 0
    for n in range(starts[0], starts[-1]):
        k += n >= starts[k + 1]
        want[n] = f"{1300 + k // 12:04d}-{k % 12 + 1:02d}-{n - starts[k] + 1:02d}"
    assert len(rows) == len(want) + 4 and all((r.hijri, r.back) == (want.get(r.n), r.n if r.n in want else None) for r in rows)
    odd = ["1444-13-01", "1444-00-01", "1444-01-00", "1444-01-31", "1299-12-29", "1601-01-01", "x", "", None, "1444-1-1"]
    got = hijri.to_gregorian(spark.createDataFrame([(t,) for t in odd], "h string"), "h").collect()
    assert [r.gregorian for r in got] == [None] * 9 + [date(2022, 7, 30)]
    short = next(k for k in range(hijri.MONTHS) if starts[k + 1] - starts[k] == 29)
    assert hijri.to_gregorian(spark.createDataFrame([(f"{1300 + short // 12}-{short % 12 + 1}-30",)], "h string"), "h").first().gregorian is None
    plan = hijri.to_hijri(days, "day")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "from_json" not in plan


TICKET = "id long, status string, follow_up_date date, closed_at timestamp, last_followup_at timestamp"
NOTE = "id long, ticket_id long, at timestamp, body string, has_status boolean, new_status string, has_follow_up_date boolean, new_follow_up_date string, actor_id string, actor_name string, actor_email string"


def _at(hour):
    return datetime(2024, 1, 1, hour)


def test_follow_ups_take_effect_one_upon_another(spark):
    table = spark.createDataFrame([(1, "open", date(2024, 2, 1), None, None), (2, "completed", None, _at(0), _at(0)), (3, "open", None, None, None), (4, None, None, None, None)], TICKET)
    who = ("a", "A", "a@x")
    notes = [
        (10, 1, _at(3), " third ", True, "completed", False, None, *who), (11, 1, _at(1), "first", True, "completed", True, "2024-03-01", *who), (12, 1, _at(2), "second", True, "open", True, "soon", *who),
        (20, 2, _at(5), "x" * 5000, None, "?", None, "?", None, None, None), (21, 2, _at(6), "again", True, "in_progress", True, "2024-04-01", *who),
        (30, 3, _at(1), " ", True, "completed", False, None, *who), (31, 3, _at(1), "b", True, "nonsense", True, "2024-05-01", *who), (32, 3, _at(1), "b", True, None, False, None, *who), (33, 9, _at(1), "b", False, None, False, None, *who), (34, None, None, "b", False, None, False, None, *who),
        (40, 4, None, "untimed", True, "cancelled", False, None, *who),
    ]
    after, events, rejects = tickets.follow_ups(table, spark.createDataFrame(notes, NOTE).repartition(3))
    got = {r.id: (r.status, r.follow_up_date, r.closed_at, r.last_followup_at) for r in after.collect()}
    assert got == {1: ("completed", None, _at(3), _at(3)), 2: ("in_progress", date(2024, 4, 1), None, _at(6)), 3: ("open", None, None, None), 4: ("cancelled", None, None, None)}
    rows = sorted((r.note_id, r.seq, r.kind, r.from_value, r.to_value) for r in events.collect())
    assert rows[:4] == [(10, 0, "followup", None, None), (10, 1, "status_changed", "open", "completed"), (10, 3, "closed", None, "completed"), (11, 0, "followup", None, None)]
    assert [r[1:] for r in rows if r[0] == 11] == [(0, "followup", None, None), (1, "status_changed", "open", "completed"), (2, "follow_up_date_changed", "2024-02-01", "2024-03-01"), (3, "closed", None, "completed")]
    assert [r[1:] for r in rows if r[0] == 12] == [(0, "followup", None, None), (1, "status_changed", "completed", "open"), (2, "follow_up_date_changed", "2024-03-01", None), (4, "reopened", "completed", "open")]
    assert [r[2] for r in rows if r[0] in (20, 21)] == ["followup", "followup", "status_changed", "follow_up_date_changed", "reopened"]
    assert [r[2] for r in rows if r[0] == 40] == ["followup", "status_changed", "closed"]
    bodies = {r.note_id: (r.body, r.actor_email) for r in events.where("kind = 'followup'").collect()}
    assert bodies[10] == ("third", "a@x") and bodies[20] == ("x" * 4000, None) and not set(bodies) & {30, 31, 32, 33, 34}
    assert {(r.id, r.outcome) for r in rejects.collect()} == {(30, "no_text"), (31, "unknown_status"), (32, "unknown_status"), (33, "no_such_ticket"), (34, "no_such_ticket")}
    again, none, nothing = tickets.follow_ups(table, spark.createDataFrame([], NOTE))
    assert sorted(again.collect()) == sorted(table.collect()) and none.collect() == [] == nothing.collect()


def test_an_unknown_kind_of_event_is_an_edit(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(*tickets.event(F.lit(1), F.lit("invented"), F.lit(None), F.lit("b" * 4001), F.lit("v" * 201), none)).first()
    assert (row.kind, len(row.body), len(row.from_value), row.to_value) == ("edited", 4000, 200, None)


def test_events_are_nested_by_time_and_id(spark):
    table = spark.createDataFrame([(1,), (2,)], "id long")
    log = [(1, 5, _at(1)), (1, 4, _at(1)), (1, 1, None), (1, 9, _at(0)), (7, 1, _at(0))]
    events = spark.createDataFrame([(t, i, "k", "b", None, None, "a", "A", at) for t, i, at in log], "ticket_id long, id long, kind string, body string, from_value string, to_value string, actor_id string, actor_name string, at timestamp")
    got = {r.id: [e.id for e in r.events] for r in tickets.with_events(table, events).collect()}
    assert got == {1: ["9", "4", "5", "1"], 2: []}
    assert [r.id for r in tickets.timeline(events).where("ticket_id = 1").orderBy("pos").collect()] == [9, 4, 5, 1]


def test_deletes_have_an_outcome_and_free_files(spark):
    base = spark.createDataFrame([(1, "a"), (2, "shared"), (3, None), (4, "shared")], "id long, file_url string")
    children = spark.createDataFrame([(1, "a"), (1, "b"), (1, ""), (1, "kept"), (2, None), (4, "kept"), (8, "orphan")], "run_id long, file_url string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "id long")
    rest, others, outcomes, freed = mutations.delete_keys(base, children, asked, "id", "run_id")
    assert sorted(r.id for r in rest.collect()) == [3, 4] and sorted(r.run_id for r in others.collect()) == [4, 8]
    assert {(r.id, r.outcome) for r in outcomes.collect()} == {(1, "deleted"), (2, "deleted"), (9, "missing")}
    assert sorted(map(tuple, freed.collect())) == [(1, "a"), (1, "b")]
    assert mutations.delete_keys(base, children, asked.limit(0), "id", "run_id")[2].collect() == []


def test_specs_expand_to_the_roles(spark):
    known = permissions.catalogue(spark)
    assert [r.permission for r in known.orderBy("place").collect()] == permissions.ALL
    rows = [("all", 0, "*", None), ("some", 0, "tickets", ["close", "view", "close", "fly"]), ("some", 1, "kpi", ["view"]), ("some", 2, "gone", ["view"]), ("both", 0, "kpi", ["view"]), ("both", 1, "*", []), ("none", 0, "kpi", []), ("none", 1, "kpi", None)]
    held = permissions.role_defaults(permissions.expand_specs(spark.createDataFrame(rows, "role string, at int, section string, actions array<string>"), known))
    got = {r.role: r.permissions for r in held.collect()}
    assert got == {"all": permissions.ALL, "some": ["tickets:close", "tickets:view", "kpi:view"], "both": permissions.ALL}
    assert {r: len(h) for r, h in permissions.ROLES.items()} == {"owner": 42, "admin": 42, "hr": 10, "finance": 3, "viewer": 7}


def test_wanted_permissions_of_any_shape(spark):
    cases = {None: (None, True), "null": (None, True), '["a", 1]': (["a", "1"], True), "[]": ([], True), "{}": (None, False), '"a"': (None, False), "": (None, False), "[": (None, False)}
    wanted, shaped = permissions.wanted_permissions(F.col("t"))
    got = {r.t: (r.w, r.s) for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", wanted.alias("w"), shaped.alias("s")).collect()}
    assert got == cases


def test_records_take_dates_of_any_kind(spark):
    k = records.EMPLOYEE_KEYS
    rows = [(1, {k["iq_exp"]: "2/30/2025", k["lic_exp"]: 1735689599999, k["eid"]: 7}), (2, {k["iq_exp"]: None, k["lic_exp"]: "1735689599999"}), (3, {k["iq_exp"]: {"a": 1}, k["lic_exp"]: True, k["name"]: ["x"]}), (4, [])]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in rows] + [(5, None), (6, "{")], "id long, data string")
    got = {r.id: (r.eid, r.name, r.iq_exp, r.lic_exp) for r in records.employee_records(frame).collect()}
    assert got == {1: ("7", None, date(2025, 3, 2), date(2024, 12, 31)), 2: (None,) * 4, 3: (None, '["x"]', None, None), 4: (None,) * 4, 5: (None,) * 4, 6: (None,) * 4}


def test_badges(spark):
    rows = [("open", date(2024, 1, d)) for d in (19, 18, 10, 9, 20, 21)] + [("completed", date(2024, 1, 1)), ("completed", date(2024, 1, 20)), ("open", None)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, status string, follow_up_date date")
    got = [r[0] for r in frame.orderBy("id").select(tickets.due_badge("2024-01-20")).collect()]
    assert got == ["متأخرة 1 يوم", "متأخرة 2 يومان", "متأخرة 10 أيام", "متأخرة 11 يومًا", "متابعة اليوم", "", "", "", ""]


def test_rows_without_a_key_do_not_meet(spark):
    events = spark.range(1000).select("id", F.lit(None).cast("string").alias("key"))
    keys = events.select(spread(F.col("key"), F.col("id")).alias("s"))
    assert keys.distinct().count() == 1000 and keys.where("s like 'E%'").count() == 0
    table = spark.createDataFrame([(1, None, None, "S", "open", None), (2, "", 5, "S", "open", None)], "id long, employee_eid string, assignee_id int, employee_iqama_at_creation string, status string, follow_up_date date")
    people = spark.createDataFrame([("", "N", "7"), (None, "Nobody", "8")], "eid string, name string, iqama string")
    accounts = spark.createDataFrame([(5, "A"), (None, "B")], "id int, name string")
    got = {r.id: (r.employee_name, r.iqama, r.assignee_name) for r in tickets.ticket_list(table, people, accounts).collect()}
    assert got == {1: (None, "S", None), 2: ("N", "7", "A")}


def test_uploads_tags_and_point_reads(spark):
    sizes = spark.range(1).select(F.repeat(F.lit("%PDF-1"), 3_500_000).cast("binary").alias("c"))
    verdict = lambda c, name: users.upload_verdict(c, F.lit("text/plain"), F.lit(name))
    row = sizes.select(verdict(F.col("c"), "a.pdf"), verdict(F.lit(b"%PDF-"), "a.pdf"), verdict(F.lit(b"%PDF-1"), "a.PDF"), verdict(F.lit(None).cast("binary"), "a"), verdict(F.lit(b"x"), "a")).first()
    assert list(row) == ["too_large", "no_pdf", None, "empty", None]
    assert list(spark.range(1).select(records.code_tag(F.lit("abc")), records.code_tag(F.lit("")), records.code_tag(F.lit(None))).first()) == ['"qr-a9993e364706816a"', None, None]
    rows = spark.createDataFrame([(12, "9" * 20)], "id long, ticket_no string")
    assert records.ticket_lookup(rows, "9" * 20).collect() == [] and records.ticket_lookup(rows, "0012").count() == 1
    settings = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    assert [[r.value for r in nested.setting(settings, "key", "value", k).collect()] for k in ("a", "b", "c")] == [["1"], [None], []]


def test_patches_of_a_permit_given_twice_are_refused(spark):
    permits = spark.createDataFrame([("p", "f", "q", "t")], "permit_no string, file_url string, qr_url string, qr_text string")
    twice = spark.createDataFrame([("p", True, "a", False, None, False, None)] * 2, "permit_no string, has_file boolean, new_file string, has_qr boolean, new_qr string, has_qr_text boolean, new_qr_text string")
    with pytest.raises(Exception, match="several rows of a patch"):
        mutations.permit_update(permits, twice).collect()


def _busy(df):
    """How many tasks return rows of df."""
    return len({r[0] for r in df.select(F.spark_partition_id()).collect()})


def test_follow_ups_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    ids = spark.range(400)
    table = ids.select("id", F.lit("open").alias("status"), F.lit(None).cast("date").alias("follow_up_date"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("timestamp").alias("last_followup_at"))
    none = F.lit(None).cast("string")
    notes = ids.select(F.col("id") + 1000, (F.col("id") % 350).alias("t"), F.lit(_at(3)), F.lit("note"), F.lit(True), F.lit("completed"), F.lit(False), none, none, none, none).toDF(*[c.split()[0] for c in NOTE.split(", ")])
    want = [sorted(map(str, df.collect())) for df in tickets.follow_ups(table, notes)]
    monkeypatch.setattr(joins, "TASK_ROWS", 20)
    after, events, rejects = tickets.follow_ups(table, notes)
    assert [sorted(map(str, df.collect())) for df in (after, events, rejects)] == want and len(want[0]) == 400
    assert _busy(after) > 30 and _busy(events) > 30


def test_typed_json_meets_in_tasks_of_bounded_size(spark, monkeypatch):
    base = spark.range(400).select(F.col("id").alias("k"), F.lit('{"a": 1}').alias("j"))
    patch = spark.range(100, 500).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, '{"b": 2}').otherwise("[]").alias("j"))
    want = [sorted(map(str, df.collect())) for df in mutations.merge_typed_json(base, patch, "k", "j")]
    for bound, value in (("TASK_ROWS", 20), ("TASK_BYTES", 150)):
        with monkeypatch.context() as m:
            m.setattr(joins, bound, value)
            after, rejects = mutations.merge_typed_json(base, patch, "k", "j")
            assert [sorted(map(str, df.collect())) for df in (after, rejects)] == want and len(want[0]) == 400
            assert _busy(after) > 30 and _busy(rejects) > 30


def test_other_patches_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    base = spark.range(400).select(F.col("id").alias("k"), F.lit('{"a": 1}').alias("j"))
    patch = spark.range(100, 500).select(F.col("id").alias("k"), F.lit('{"b": 2}').alias("j"), F.lit(True).alias("has_j"), F.lit("new").alias("new_j"))
    made = lambda: [mutations.merge_json(base, patch, "k", "j"), *mutations.update_columns(base, patch, "k", ["j"])]
    want = [sorted(map(str, df.collect())) for df in made()]
    monkeypatch.setattr(joins, "TASK_ROWS", 20)
    got = made()
    assert [sorted(map(str, df.collect())) for df in got] == want and [len(rows) for rows in want] == [400, 400, 100]
    assert all(_busy(df) > 30 for df in got[:2])
