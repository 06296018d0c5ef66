"""Rules on literal cases, and what plans look like."""

import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import dates, strings
from larkspur.operators import expiry, hijri, mutations, nested, pdf_images, permissions, records, tickets, verdicts
from larkspur.operators.ordering import with_position
from larkspur.plans.catalogue import text_document
from larkspur.sources.views import view

DIR = "/root/testdata/sf0.001"


#: (text, the date it stands for)
DATE_CASES = [
    (None, None), ("", None), ("garbage", None), ("a/b/c", None), ("1/2", None), ("2025-13-01", None), ("2025-12-31", "2025-12-31"), ("2025-12", "2025-12-01"),
    ("2025-2-3", "2025-02-03"), ("2025-02-30", "2025-03-02"), ("12/31/2025", "2025-12-31"), ("1/5/2025", "2025-01-05"), ("13/40/2025", "2026-02-09"), ("1/5/25", "1925-01-05"),
    ("2025-12-31T10:00:00Z", "2025-12-31"), ("2025", "2025-01-01"), ("0/5/2025", "2024-12-05"), ("1/0/2025", "2024-12-31"), ("2025-12-31 10:00", None),
]


def test_parse_date(spark):
    rows = spark.createDataFrame(DATE_CASES, "text string, want string").select("want", dates.parse_date(F.col("text")).cast("string").alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_ladder(spark):
    rows = spark.createDataFrame([(n,) for n in (-400, -1, 0, 1, 2, 3, 4, 5, 6, None)], "n int").select(dates.stage(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["overdue", "overdue", "today", None, "2day", None, None, "5day", None, None]


def test_text_rules(spark):
    row = spark.createDataFrame([(" \t x y \n", "٣4-5", "a b/ت.pdf", "UP/..x y", "HTTP://x", '<&">')], "a string, b string, c string, d string, e string, f string").select(
        strings.clean(F.col("a")), strings.digits(F.col("b")), strings.safe_filename(F.col("c")), strings.safe_prefix(F.col("d")), strings.is_url(F.col("e")), strings.escape_html(F.col("f")), strings.ticket_number(F.lit(2026), F.lit(10000)), strings.overdue_badge(F.lit(2)), dates.long_date(F.lit("2025-02-03").cast("date"))
    ).first()
    assert list(row) == ["x y", "45", "a_b_ت.pdf", "UP/xy", True, "&lt;&amp;&quot;&gt;", "TKT-2026-10000", "متأخرة 2 يومان", "3 فبراير 2025"]


def test_latest_permit_ties_and_null_dates(spark):
    rows = [(1, "a", "2020-01-01"), (2, "a", "2020-01-01"), (3, "b", None), (4, "b", "1960-01-01"), (5, "c", None), (6, "d", None), (7, "d", "2000-01-01")]
    frame = spark.createDataFrame(rows, "id long, iqama string, day string").select("id", "iqama", F.concat(F.lit("P"), "id").alias("permit_no"), F.col("day").cast("date").alias("issue_date"), F.lit(None).cast("date").alias("expiry_date"))
    assert {r.iqama: r.id for r in expiry.latest_permits(frame).collect()} == {"a": 1, "b": 3, "c": 5, "d": 7}


def test_one_alert_is_a_single_mail(spark):
    alert = spark.createDataFrame([(1, "N", "T", date(2025, 1, 2), 2, "2day")], "pos long, employee_name string, type_label string, expiry date, remaining_days int, stage string")
    people = spark.createDataFrame([("a@x",), ("b@x",)], "email string")
    got = {r.email: r for r in expiry.alert_mails(alert, people, spark.createDataFrame([("a@x", "hi")], "email string, greeting string")).collect()}
    assert got["a@x"].kind == "single" and got["a@x"].line.startswith("N — T — 2 يناير 2025") and got["b@x"].error and got["b@x"].line is None
    assert expiry.alert_mails(alert.limit(0), people, spark.createDataFrame([("a@x", "hi")], "email string, greeting string")).count() == 0


def test_positions_are_those_of_a_sort(spark):
    frame = spark.createDataFrame([(int(x),) for x in np.random.default_rng(0).permutation(5000)], "x long").repartition(7)
    assert all(r.pos == r.x + 1 for r in with_position(frame, F.col("x").asc()).collect())
    assert with_position(frame.limit(0), F.col("x").asc()).collect() == []


def test_nesting(spark):
    parents = spark.createDataFrame([(1,), (2,)], "run long")
    children = spark.createDataFrame([(1, 20, "b"), (1, 10, "a"), (3, 1, "z")], "run long, id long, key string")
    got = {r.run: [c.key for c in r.files] for r in nested.nest(parents, children, "run", "id", "files").collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_merge_and_insert(spark):
    base = spark.createDataFrame([(1, '{"a": "1", "b": "2"}'), (2, None), (3, '{"a": "x"}')], "k long, j string")
    patch = spark.createDataFrame([(1, '{"b": null, "c": "3"}'), (2, '{"z": "1"}')], "k long, j string")
    assert {r.k: r.j for r in mutations.merge_json(base, patch, "k", "j").collect()} == {1: {"a": "1", "b": None, "c": "3"}, 2: {"z": "1"}, 3: {"a": "x"}}
    rows = spark.createDataFrame([(1, 5), (9, 7), (9, 6)], "k long, o long")
    got = mutations.insert_if_absent(spark.createDataFrame([(1, 0)], "k long, o long"), rows, "k", "o").collect()
    assert sorted((r.k, r.o, r.outcome) for r in got) == [(1, 0, "kept"), (1, 5, "rejected"), (9, 6, "inserted"), (9, 7, "rejected")]
    twice = mutations.upsert(mutations.upsert(base, patch, ["k"], ["j"]), patch, ["k"], ["j"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, mutations.upsert(base, patch, ["k"], ["j"]).collect()))


def test_permit_update_rules(spark):
    permits = spark.createDataFrame([("p", "https://f", "https://q", "old")], "permit_no string, file_url string, qr_url string, qr_text string")
    kind = "permit_no string, has_file boolean, new_file string, has_qr boolean, new_qr string, has_qr_text boolean, new_qr_text string"

    def after(*patch):
        return tuple(mutations.permit_update(permits, spark.createDataFrame([("p", *patch)], kind)).first())[1:]

    assert after(False, None, False, None, False, None) == ("https://f", "https://q", "old", [])
    assert after(False, None, True, "/api/qr", False, None) == ("https://f", None, "old", ["https://q"])
    assert after(True, "https://n", False, None, True, " new ") == ("https://n", None, "new", ["https://f", "https://q"])
    assert after(True, None, False, None, True, "new") == (None, None, None, ["https://f", "https://q"])


def test_permissions(spark):
    rows = [("owner", []), ("viewer", None), ("viewer", ["kpi:view", "gone:x", "finance:view", "kpi:view"]), ("hr", []), ("nobody", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "role string, p array<string>").select(permissions.effective(F.col("role"), F.col("p"))).collect()]
    assert [len(x) for x in got] == [42, 7, 2, 0, 0, 0] and got[2] == ["kpi:view", "finance:view"] and len(permissions.ROLES["hr"]) == 10 and len(permissions.ROLES["finance"]) == 3


def test_change_events(spark):
    kind = "id long, status string, priority string, assignee_id int, follow_up_date date, title string"
    old = spark.createDataFrame([(1, "completed", "high", None, None, "t"), (2, "completed", "high", 1, None, None), (3, "open", "high", 1, None, "a")], kind)
    new = spark.createDataFrame([(1, "open", "high", None, date(2024, 1, 1), " t "), (2, "cancelled", "low?", 1, None, None), (3, "completed", "urgent", None, None, "")], kind)
    got = sorted((r.ticket_id, r.seq, r.kind, r.from_value, r.to_value) for r in tickets.change_events(old, new, ("title",)).collect())
    assert [g[:3] for g in got] == [(1, 0, "status_changed"), (1, 3, "follow_up_date_changed"), (1, 101, "reopened"), (3, 0, "status_changed"), (3, 1, "priority_changed"), (3, 2, "assignee_changed"), (3, 10, "edited"), (3, 100, "closed")]
    assert got[6][3:] == ("title", "—")


def test_verdict_order(spark):
    employees = spark.createDataFrame([("e", "12", "2025-01-01", None)], "eid string, iqama string, iqama_expiry string, license_expiry string")
    cases = [("e", "passport", "2026-01-01", None), ("x", "iqama", "2026-01-01", None), ("e", "iqama", "2026-01-01", "id 13"), ("e", "iqama", None, "1-2"), ("e", "iqama", "2024-12-31", None), ("e", "iqama", "2025-01-01", None), ("e", "iqama", "2025-01-02", "12"), ("e", "work_license", "2025-99-99", None)]
    frame = spark.createDataFrame([(*c[:3], None, c[3], "u", k) for k, c in enumerate(cases)], "eid string, doc_type string, gregorian string, hijri string, document_id string, file_url string, k int")
    got = [r.reason for r in sorted(verdicts.expiry_verdicts(frame, employees).collect(), key=lambda r: r.k)]
    assert got == ["unknown_document_type", "employee_not_found", "identity_mismatch", "no_date", "older_than_current", "unchanged", "updated", "set"]


def test_hijri_cases(spark):
    cases = {"1444-01-01": date(2022, 7, 30), "1445-01-01": date(2023, 7, 19), "1446-01-01": date(2024, 7, 7), "1447-01-01": date(2025, 6, 26), "1299-01-01": None, "1601-01-01": None, "1444-13-01": None}
    got = hijri.to_gregorian(spark.createDataFrame([(k,) for k in cases], "h string"), "h").collect()
    assert {r.h: r.gregorian for r in got} == cases


@pytest.mark.parametrize("channels", [1, 3])
def test_png_rows_round_trip(channels):
    rng = np.random.default_rng(channels)
    w, h = 7, 10
    pixels = rng.integers(0, 256, (h, w * channels)).astype(int)
    lines = []
    for y in range(h):
        line = [y % 5]
        for x in range(w * channels):
            a = pixels[y][x - channels] if x >= channels else 0
            b = pixels[y - 1][x] if y else 0
            c = pixels[y - 1][x - channels] if y and x >= channels else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((pixels[y][x] - [0, a, b, (a + b) // 2, near][y % 5]) % 256)
        lines.append(line)
    assert pdf_images.unfiltered(np.array(lines, np.uint8).tobytes(), w, channels) == pixels.astype(np.uint8).tobytes()


def test_pdf_images(spark):
    bad = b"%PDF-1 1 0 obj << /Subtype /Image /Width 9 /Height 9 /BitsPerComponent 8 /DeviceGray /FlateDecode >> stream\n" + zlib.compress(b"x" * 10) + b"endstream endobj"
    frame = spark.createDataFrame([(1, text_document(5, "some text")), (2, b"no pdf"), (3, bad), (4, None), (5, b"%PDF-")], "doc_id long, content binary")
    rows = pdf_images.candidates(pdf_images.extract_images(frame)).collect()
    assert rows and {r.doc_id for r in rows} == {1} and all(len(r.pixels) == r.width * r.height * r.channels for r in rows)
    assert pdf_images.rgba(b"\x01\x02", 1) == b"\x01\x01\x01\xff\x02\x02\x02\xff"


def test_scan_plans(spark):
    """The scan prunes columns and joins the catalogue by broadcast."""
    rows = expiry.scan_expirations(*(view(spark, DIR, v) for v in ("employees", "permits", "document_types")), today="2001-08-01")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "o_totalprice" not in plan


def test_patches_of_several_rows_for_a_key_are_refused(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "key long, name string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "key long, name string")
    with pytest.raises(Exception, match="several rows of a patch"):
        mutations.upsert(base, twice, ["key"], ["name"]).collect()
    as_json = lambda df: df.select("key", F.to_json(F.struct("name")).alias("name"))
    with pytest.raises(Exception, match="several rows of a patch"):
        mutations.merge_json(as_json(base), as_json(twice), "key", "name").collect()
    got = mutations.merge_json(as_json(base).withColumn("new", F.lit(5)), as_json(twice.where("name = 'z' or name = 'x'")), "key", "name")
    assert {(r.key, r.name["name"], r.new) for r in got.collect()} == {(1, "x", 5), (2, "b", 5)}


def test_upsert_on_two_keys(spark):
    base = spark.createDataFrame([(1, "a", "old"), (1, "b", "old")], "run long, key string, note string")
    patch = spark.createDataFrame([(1, "b", None), (2, "a", "new")], "run long, key string, note string")
    assert {tuple(r) for r in mutations.upsert(base, patch, ["run", "key"], ["note"]).collect()} == {(1, "a", "old"), (1, "b", None), (2, "a", "new")}


def test_a_patch_without_a_field_leaves_it(spark):
    old = spark.createDataFrame([(1, "open", "high", 3, None, None)], "id long, status string, priority string, assignee_id int, follow_up_date date, closed_at timestamp")
    only = spark.createDataFrame([(1, 4)], "id long, assignee_id int")
    assert [tuple(r) for r in tickets.change_events(old, only).collect()] == [(1, 2, "assignee_changed", "3", "4")]
    got = tickets.updated(old, only, "2024-01-01 00:00:00").first()
    assert (got.status, got.priority, got.assignee_id, got.closed_at) == ("open", "high", 4, None)
    unknown = spark.createDataFrame([(1, None)], "id long, status string")
    assert tickets.change_events(old, unknown).collect() == [] and tickets.updated(old, unknown, "2024-01-01 00:00:00").first().status == "open"


def test_lookups_by_digits_and_by_number(spark):
    rows = spark.createDataFrame([(12, "TKT-2024-0001")], "id long, ticket_no string")
    assert records.ticket_lookup(rows, "12").count() == records.ticket_lookup(rows, "TKT-2024-0001").count() == 1
    assert records.ticket_lookup(rows, "\u0661\u0662").count() == 0
