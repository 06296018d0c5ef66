"""The workforce tables, derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The day on which scans are run, and the day on which tickets are looked at.
AS_OF, TODAY = "2001-08-01", "2024-01-20"

#: view: (driver tables it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "employees": (
        ["customer"],
        """select c_custkey as id, concat('E', cast(c_custkey as string)) as eid, cast(c_custkey as string) as iqama, c_name as name,
        date '2001-08-01' + cast((c_custkey * 7) % 61 - 20 as int) as iq_exp, date '2001-08-01' + cast((c_custkey * 11) % 61 - 20 as int) as lic_exp
        from {customer}""",
    ),
    "permits": (
        ["orders"],
        """select o_orderkey as id, concat('P', cast(o_orderkey as string)) as permit_no, cast(o_custkey as string) as iqama,
        case when o_orderkey % 97 = 0 then null else cast(o_orderdate as date) end as issue_date, cast(o_orderdate as date) + 90 as expiry_date
        from {orders}""",
    ),
    "document_types": (
        [],
        "select * from (values ('iqama','Residence','iqExp',1),('license','Licence','licExp',2),('ajeer','Permit','ajeerExp',3)) as t(key, label, employee_field, sort_order)",
    ),
    "recipients": ([], "select * from (values (1, 'First Reader', 'first@example.org'), (2, 'Second Reader', 'second@example.org')) as t(id, name, email)"),
    "tickets": (
        ["events"],
        """select event_id as id, ts as opened_at, cast(event_id % 120 as int) as assignee_id,
        case when event_id % 29 = 0 then null when event_id % 13 = 0 then concat('X', cast(user_id as string)) else concat('E', cast(user_id as string)) end as employee_eid,
        concat('S', cast(event_id % 1000 as string)) as employee_iqama_at_creation,
        case event_id % 4 when 0 then 'normal' when 1 then 'medium' when 2 then 'high' else 'urgent' end as priority,
        case event_id % 6 when 0 then 'open' when 1 then 'awaiting_counterparty' when 2 then 'awaiting_us' when 3 then 'in_progress' when 4 then 'completed' else 'cancelled' end as status,
        case when event_id % 5 = 0 then null else cast(ts as date) + cast(event_id % 17 as int) end as follow_up_date,
        case when event_id % 6 in (4, 5) then ts + interval '20' day end as closed_at
        from {events}""",
    ),
    "ticket_events": (["conversations"], "select conv_id as ticket_id, turn as id, role as kind, text as body from {conversations}"),
    "readers": (
        ["region"],
        "select r_regionkey as id, r_name as name, concat(lower(r_name), '@example.org') as email from {region}",
    ),
    "ticket_log": (
        ["conversations"],
        """select conv_id as ticket_id, cast(turn as bigint) as id, role as kind, text as body, case when turn % 2 = 0 then cast(turn as string) end as from_value,
        case when turn % 3 = 0 then role end as to_value, concat('u', cast(conv_id % 7 as string)) as actor_id, case when conv_id % 7 > 2 then 'Some One' end as actor_name,
        case when turn % 5 = 4 then null else cast(date '2024-01-01' as timestamp) + interval '1' hour * cast((turn * 7) % 4 as int) end as at
        from {conversations}""",
    ),
    "ticket_table": (
        ["events"],
        """select event_id as id, concat('TKT-', cast(event_id as string)) as ticket_no, concat(event_type, ' ', cast(event_id as string)) as title,
        case when event_id % 3 = 0 then props end as description, case when event_id % 2 = 0 then 'other' else 'renew_iqama' end as type,
        case event_id % 4 when 0 then 'normal' when 1 then 'medium' when 2 then 'high' else 'urgent' end as priority,
        case event_id % 6 when 0 then 'open' when 1 then 'awaiting_counterparty' when 2 then 'awaiting_us' when 3 then 'in_progress' when 4 then 'completed' else 'cancelled' end as status,
        'Some Company' as counterparty, case when event_id % 13 = 0 then null else concat('E', cast(user_id as string)) end as employee_eid,
        concat('S', cast(event_id % 1000 as string)) as employee_iqama_at_creation, concat('u', cast(event_id % 9 as string)) as created_by_id, 'Maker' as created_by_name,
        cast(event_id % 120 as int) as assignee_id, cast(ts as timestamp) as opened_at, cast(null as timestamp) as last_followup_at,
        case when event_id % 5 = 0 then null else cast(ts as date) + cast(event_id % 17 as int) end as follow_up_date,
        case when event_id % 6 in (4, 5) then cast(ts as timestamp) + interval '20' day end as closed_at, case when event_id % 8 = 0 then 'a note' end as notes
        from {events}""",
    ),
    "users": (
        ["supplier"],
        """select cast(s_suppkey as int) as id, s_name as name,
        case s_suppkey % 5 when 0 then 'owner' when 1 then 'admin' when 2 then 'hr' when 3 then 'finance' else 'viewer' end as role,
        cast(s_suppkey % 3 as int) as perm_mode from {supplier}""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A workforce table over the driver's tables in sf_dir."""
    tables, sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def duckdb_ctes(*names: str) -> str:
    """WITH clause that defines the named views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names)
