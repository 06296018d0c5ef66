"""Accounts: what is shown of them, lookups with fallback accounts, and the rules of changing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.mutations import update_columns
from larkspur.operators.permissions import CATALOGUE, ROLES

SECRETS = ["password_hash"]


def public(users: DataFrame) -> DataFrame:
    """users without secrets."""
    return users.drop(*SECRETS)


def with_fallback(users: DataFrame, accounts: list[tuple | None]) -> DataFrame:
    """users and the fallback accounts (rows of the same columns) that are given, with source: 0 for the table, 1 for a fallback."""
    given = [a for a in accounts if a is not None]
    rows = users.withColumn("source", F.lit(0))
    if not given:
        return rows
    return rows.unionByName(users.sparkSession.createDataFrame(given, users.schema).withColumn("source", F.lit(1)))


def _first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("source", "id").limit(1).drop("source")


def by_email(users: DataFrame, email: str, accounts: list[tuple | None] = ()) -> DataFrame:
    """The account of an address, whatever its case: the table's, or else a fallback."""
    return _first(with_fallback(users, accounts).where(F.lower("email") == F.lower(F.lit(email))))


def by_id(users: DataFrame, id_: str, accounts: list[tuple | None] = ()) -> DataFrame:
    """The account of an id: the table's, or else a fallback."""
    return _first(with_fallback(users, accounts).where(F.col("id") == id_))


def taken(users: DataFrame, id_: str, email: str) -> bool:
    """Whether an account has that id or, whatever its case, that address."""
    return not users.where((F.col("id") == id_) | (F.lower("email") == F.lower(F.lit(email)))).limit(1).isEmpty()


#: What an update of an account may give; of these texts, empty ones become null.
FIELDS, BLANK = ["name", "email", "password_hash", "role", "status", "job_title", "permissions", "last_login"], ("job_title",)


def update_users(users: DataFrame, patch: DataFrame, accounts: list[tuple | None] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users after the patch, fallback accounts as the patch would have them, ids that are neither's).

    patch: id, and new_<field> and has_<field> of the fields that it may give. permissions have three states: not given, they stay; null, the account is back to
    its role's defaults; an array, also an empty one, replaces them. The table's account comes before a fallback of the same id; a fallback
    shows what it was asked for, without secrets, and nothing of it is stored. A patch of several rows for an id is refused.
    """
    after, missing = update_columns(users, patch, "id", FIELDS, BLANK)
    given = [a for a in accounts if a is not None]
    if not given:
        return after, public(after.limit(0)), missing
    spare = users.sparkSession.createDataFrame(given, users.schema)
    asked = patch.join(F.broadcast(missing), "id", "left_semi").join(F.broadcast(spare.select("id")), "id", "left_semi")
    shown, _ = update_columns(spare.join(F.broadcast(asked.select("id").distinct()), "id", "left_semi"), asked, "id", FIELDS, BLANK)
    return after, public(shown), missing.join(F.broadcast(spare.select("id")), "id", "left_anti")


def may_manage(actor_role: Column, target_role: Column) -> Column:
    """Only an owner manages an owner."""
    return (actor_role == "owner") | (target_role != "owner")


def has(role: Column, held: Column, permission: str) -> Column:
    return (role == "owner") | F.array_contains(held, permission)


def has_any(held: Column, permissions: list[str]) -> Column:
    return F.arrays_overlap(held, F.array(*map(F.lit, permissions)))


def create_verdict(actor_role: Column, actor_held: Column, name: Column, email: Column, role: Column) -> Column:
    """Why an account is not created, by the first rule that speaks against it; null if none does."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(~has(actor_role, actor_held, "users:create"), "not_allowed")
        .when(empty(name) | empty(email) | empty(role), "missing_field")
        .when(~role.isin(*ROLES), "unknown_role")
        .when(~may_manage(actor_role, role), "owner_only")
    )


def edit_verdict(actor_role: Column, actor_held: Column, target_role: Column, role: Column, has_details: Column) -> Column:
    """Why an edit of an account's details is refused; a null or empty role, or the one that the account has, is no change of it."""
    other = (F.coalesce(role, F.lit("")) != "") & ~role.eqNullSafe(target_role)
    return (
        F.when(~has(actor_role, actor_held, "users:edit") & ~has(actor_role, actor_held, "users:manage"), "not_allowed")
        .when(target_role.isNull(), "not_found")
        .when(~may_manage(actor_role, target_role), "target_is_owner")
        .when(other & ~role.isin(*ROLES), "unknown_role")
        .when(other & (role == "owner") & (actor_role != "owner"), "owner_only")
        .when(has_details & ~has(actor_role, actor_held, "users:edit"), "not_allowed")
    )


def delete_verdict(actor_role: Column, actor_held: Column, actor_id: Column, target_id: Column, target_role: Column) -> Column:
    """Why an account is not deleted."""
    return (
        F.when(~has(actor_role, actor_held, "users:delete"), "not_allowed")
        .when(target_id == actor_id, "own_account")
        .when(target_role.isNull(), "not_found")
        .when(~may_manage(actor_role, target_role), "target_is_owner")
    )


#: What each action on files needs in a section.
FILE_ACTIONS = {"upload": "upload_files", "delete": "delete_files"}


def file_verdict(role: Column, held: Column, section: Column, action: Column) -> Column:
    """Why an action on a section's files is refused: action or section unknown for files, or the right missing; null if it isn't."""
    need = F.coalesce(*[F.when(action == a, p) for a, p in FILE_ACTIONS.items()])
    known = F.lit(False)
    for name, actions in CATALOGUE.items():
        known = known | ((section == name) & F.coalesce(need.isin(*actions), F.lit(False)))
    wanted = F.concat_ws(":", section, need)
    return F.when(need.isNull(), "unknown_action").when(~F.coalesce(known, F.lit(False)), "no_files_in_section").when((role != "owner") & ~F.array_contains(held, wanted), "not_allowed")


#: Fixed value: most bytes of an upload.
MOST_UPLOAD = 20 << 20


def upload_verdict(content: Column, content_type: Column, file_name: Column) -> Column:
    """Why an upload is refused: larger than MOST_UPLOAD, empty, or declared as a PDF, by its type or name, without being one; null if it isn't."""
    declared = F.coalesce(content_type.rlike("(?i)pdf"), F.lit(False)) | F.coalesce(file_name.rlike("(?i)\\.pdf$"), F.lit(False))
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size > MOST_UPLOAD, "too_large").when(size == 0, "empty").when(declared & ((F.substring(content, 1, 5) != F.lit(b"%PDF-")) | (size <= 5)), "no_pdf")


def audit_tail(log: DataFrame, most: int = 200, order: str = "ts", tie: str = "id") -> DataFrame:
    """The newest entries of a log, as they are shown: ts, type, actor_email, actor_id, target_id, meta and pos; of equal times the greater tie comes first."""
    newest = log.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(most)
    pos = F.row_number().over(Window.orderBy(F.col(order).desc(), F.col(tie).desc()))  # over `most` rows
    return newest.select(F.col(tie).alias("id"), F.col(order).alias("ts"), "type", "actor_email", "actor_id", "target_id", "meta", pos.alias("pos"))


def append_audit(log: DataFrame, entries: DataFrame) -> DataFrame:
    """log and the entries, in which empty actors and targets are null and missing details an empty object."""
    blank = [F.nullif(c, F.lit("")).alias(c) for c in ("actor_email", "actor_id", "target_id")]
    return log.unionByName(entries.select("ts", "type", *blank, F.coalesce("meta", F.lit("{}")).alias("meta")))
