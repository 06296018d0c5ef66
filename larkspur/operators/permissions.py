"""Permissions by set algebra over a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections and the actions they support, in catalogue order.
CATALOGUE = {
    "kpi": ["view"],
    "finance": ["view"],
    "employees": ["view", "create", "edit", "delete", "upload_files", "delete_files"],
    "payroll": ["view", "create", "edit", "delete", "upload_files", "delete_files"],
    "ajeer": ["view", "create", "edit", "delete", "upload_files", "delete_files"],
    "tickets": ["view", "create", "edit", "add_followup", "close", "delete"],
    "contact": ["view"],
    "users": ["view", "create", "edit", "delete", "manage"],
    "settings": ["view", "edit"],
    "document_types": ["view", "create", "edit", "delete"],
    "recipients": ["view", "create", "edit", "delete"],
}
ALL = [f"{section}:{action}" for section, actions in CATALOGUE.items() for action in actions]
#: What a role has by default, section by section; * is everything.
ROLE_SPECS: dict[str, str | dict[str, list[str]]] = {
    "owner": "*",
    "admin": "*",
    "hr": {"kpi": ["view"], "employees": ["view"], "ajeer": ["view"], "contact": ["view"], "settings": ["view"], "tickets": ["view", "create", "edit", "add_followup", "close"]},
    "finance": {"finance": ["view"], "payroll": ["view"], "settings": ["view"]},
    "viewer": {"kpi": ["view"], "finance": ["view"], "employees": ["view"], "ajeer": ["view"], "contact": ["view"], "settings": ["view"], "tickets": ["view"]},
}
#: The action that a request's verb asks for.
VERBS = {"GET": "view", "POST": "create", "PUT": "edit", "DELETE": "delete"}


def _expanded(spec: str | dict[str, list[str]]) -> list[str]:
    """The permissions of the catalogue that a role's spec names, in its order."""
    return list(ALL) if spec == "*" else [p for section, actions in spec.items() for p in (f"{section}:{a}" for a in actions) if p in ALL]


ROLES = {role: _expanded(spec) for role, spec in ROLE_SPECS.items()}


def catalogue(spark: SparkSession) -> DataFrame:
    """section, action, permission and place of every permission, in catalogue order."""
    rows = spark.createDataFrame(list(enumerate(CATALOGUE.items())), "at int, of struct<section:string,actions:array<string>>")
    rows = rows.select("at", "of.section", F.posexplode("of.actions").alias("within", "action"))
    return rows.select("section", "action", F.concat_ws(":", "section", "action").alias("permission"), (F.col("at") * 1000 + F.col("within")).alias("place"))


def expand_specs(specs: DataFrame, known: DataFrame) -> DataFrame:
    """role, permission and place (in the spec) of each permission that specs give to a role, once.

    specs: role, at (the place of the row in its role's spec), section and actions (array). A section of * stands for the whole catalogue, in its order. What the catalogue,
    known, hasn't is left out, null and empty lists of actions give nothing, and a permission given twice counts where it stands first.
    """
    everything = specs.where("section = '*'").select("role", "at").crossJoin(F.broadcast(known)).select("role", "permission", "at", F.col("place").alias("within"))
    named = specs.where("section != '*'").select("role", "at", "section", F.posexplode("actions").alias("within", "action"))
    named = named.join(F.broadcast(known.select("section", "action", "permission")), ["section", "action"]).select("role", "permission", "at", "within")
    rows = everything.unionAll(named).groupBy("role", "permission").agg(F.min(F.struct("at", "within")).alias("at"))
    return rows.select("role", "permission", (F.col("at.at") * 1_000_000 + F.col("at.within")).alias("place"))


def role_defaults(expanded: DataFrame) -> DataFrame:
    """role and permissions (array, in order) of expand_specs(); a role has no more than the catalogue."""
    return expanded.groupBy("role").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "permission"))), lambda x: x["permission"]).alias("permissions"))


def verb_action(verb: Column) -> Column:
    """The action of a request's verb, whatever its case; null for one that isn't served."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair]), F.upper(verb))


def request_verdict(role: Column, held: Column, section: Column, verb: Column) -> Column:
    """Why a request on a section is refused: its section or its verb unknown, or the permission missing; null if it isn't. An action that the section hasn't is no one's but an owner's."""
    action = verb_action(verb)
    known = F.coalesce(section.isin(*CATALOGUE), F.lit(False))
    return F.when(~known, "no_such_section").when(action.isNull(), "no_such_verb").when((role != "owner") & ~F.array_contains(held, F.concat_ws(":", section, action)), "not_allowed")


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def sanitized(permissions: Column) -> Column:
    """Those of the catalogue that are in permissions, each once, in catalogue order."""
    return F.array_intersect(_texts(ALL), permissions)


def effective(role: Column, permissions: Column) -> Column:
    """An owner has all; an array replaces the role's defaults, also an empty one; an unknown role has none."""
    defaults = _texts([])
    for name, held in ROLES.items():
        defaults = F.when(role == name, _texts(held)).otherwise(defaults)
    return F.when(role == "owner", _texts(ALL)).when(permissions.isNotNull(), sanitized(permissions)).otherwise(defaults)


def uses_defaults(role: Column, permissions: Column) -> Column:
    return (role == "owner") | permissions.isNull()


def change_verdict(actor_role: Column, actor_held: Column, actor_id: Column, target_role: Column, target_id: Column, wanted: Column, well_formed: Column | None = None) -> Column:
    """Why a change of permissions is refused, by the first rule that speaks against it; null if none does.

    wanted is null for the role's defaults; well_formed, true by default, says whether what was asked for is null or an array at all.
    """
    more = F.array_except(sanitized(wanted), actor_held)
    return (
        F.when((actor_role != "owner") & ~F.array_contains(actor_held, "users:manage"), "not_allowed")
        .when(target_role == "owner", "target_is_owner")
        .when(target_id == actor_id, "own_account")
        .when(~F.coalesce(F.lit(True) if well_formed is None else well_formed, F.lit(False)), "invalid_shape")
        .when((actor_role != "owner") & wanted.isNotNull() & (F.size(more) > 0), F.concat(F.lit("escalation: "), F.array_join(more, ", ")))
    )


def may_set_status(role: Column, held: Column, now: Column, wanted: Column) -> Column:
    """A step from or to a closed status needs the right to close, any other the right to edit."""
    closed = F.coalesce(now.isin("completed", "cancelled"), F.lit(False)) | F.coalesce(wanted.isin("completed", "cancelled"), F.lit(False))
    return (role == "owner") | F.array_contains(held, F.when(closed, "tickets:close").otherwise("tickets:edit"))


def wanted_permissions(text: Column) -> tuple[Column, Column]:
    """(the permissions that a JSON text asks for, whether it is null or an array): null for a missing text and for JSON's null; entries that are no texts count by their JSON texts."""
    value = F.try_parse_json(text)
    nothing = text.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
    entries = F.try_variant_get(value, "$", "array<string>")
    return F.when(~nothing, entries), nothing | entries.isNotNull()
