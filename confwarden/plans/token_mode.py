"""Token mode: switch named clients of every tenant between light and regular tokens.

For each client a template names: add the ``sub`` mapper if there is none, set the mode
attribute, set the claim of the known mappers; if the client has fine-grained
authorization, also set ``fetchRoles`` in each of its role policies.  The mapper literals
stay "true" in both modes, so neither mode undoes the other completely.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.functions import (
    client_path,
    has_mapper,
    insert_mapper,
    map_upsert,
    patch_mappers,
    policy_path,
    stale_mapper,
)
from confwarden.functions.documents import edited_client, edited_policy
from confwarden.operators.clients import (
    CLIENT_KEY,
    authz_clients,
    drop_reserved,
    expand_targets,
    first_of_name,
    missing_targets,
    named_by_template,
    split_by_authz,
)
from confwarden.operators.lookup import only_found
from confwarden.operators.refs import policies_of_type

MODES = {"lightweight": "true", "regular": "false"}


@dataclass(frozen=True)
class TokenModePlan:
    """``missing`` are targets no client answers to, ``without_policies`` clients that
    have the flag but no role policy; both are warnings.  ``rejected`` are clients and policies
    whose whole document cannot be edited; they are in no plan."""

    clients: DataFrame
    policies: DataFrame
    missing: DataFrame
    without_policies: DataFrame
    rejected: DataFrame


def mapper_documents(mappers):
    """Mappers under the field names of the configuration documents."""
    return F.transform(
        mappers,
        lambda m: F.struct(
            m["name"].alias("name"),
            m["protocol"].alias("protocol"),
            m["protocol_mapper"].alias("protocolMapper"),
            m["consent_required"].alias("consentRequired"),
            m["config"].alias("config"),
        ),
    )


def client_body(attributes, mappers):
    """A client document as JSON, of the fields a flat export has."""
    return F.to_json(
        F.struct(
            F.col("client_uuid").alias("id"),
            F.col("client_id").alias("clientId"),
            F.col("authz_enabled").alias("authorizationServicesEnabled"),
            attributes.alias("attributes"),
            mapper_documents(mappers).alias("protocolMappers"),
        )
    )


def patch_clients(clients: DataFrame, value: str) -> DataFrame:
    """Plan rows for ``clients``; ``changed`` says whether a row alters anything."""
    attribute = F.col("attributes").getItem(fixed.TOKEN_MODE_ATTRIBUTE)
    mappers = F.col("protocol_mappers")
    insert_sub = ~has_mapper(mappers, fixed.SUB_MAPPER["name"])
    stale = stale_mapper(mappers, fixed.PATCHED_MAPPERS, fixed.CLAIM_KEY, "true")
    patched = patch_mappers(
        insert_mapper(mappers, fixed.SUB_MAPPER), fixed.PATCHED_MAPPERS, fixed.CLAIM_KEY, "true"
    )
    body = client_body(map_upsert(F.col("attributes"), fixed.TOKEN_MODE_ATTRIBUTE, value), patched)
    if "document" in clients.columns:  # the whole document, edited in place, or null
        body = edited_client(F.col("document"), value)
    return split_by_authz(clients).select(
        *CLIENT_KEY,
        "client_id",
        "status",
        F.lit("patch").alias("action"),
        client_path(F.col("realm"), F.col("client_uuid")).alias("resource_path"),
        insert_sub.alias("insert_sub"),
        mappers.isNull().alias("no_mappers"),
        (insert_sub | stale | ~attribute.eqNullSafe(F.lit(value))).alias("changed"),
        body.alias("body"),
    )


def patch_policies(policies: DataFrame, value: str) -> DataFrame:
    """Plan rows that set ``fetchRoles`` in role policies."""
    current = F.col("config").getItem(fixed.FETCH_ROLES_KEY)
    body = F.to_json(
        F.struct(
            F.col("policy_id").alias("id"),
            "name",
            "type",
            map_upsert(F.col("config"), fixed.FETCH_ROLES_KEY, value).alias("config"),
        )
    )
    if "document" in policies.columns:  # the whole document, edited in place, or null
        body = edited_policy(F.col("document"), value)
    return policies.select(
        *CLIENT_KEY,
        F.col("policy_id").alias("target_id"),
        F.lit("patch").alias("action"),
        policy_path(F.col("realm"), F.col("client_uuid"), F.col("policy_id")).alias(
            "resource_path"
        ),
        (~current.eqNullSafe(F.lit(value))).alias("changed"),
        body.alias("body"),
    )


def _without_body(plan: DataFrame, kind: str) -> DataFrame:
    return plan.filter(F.col("body").isNull()).select(
        *CLIENT_KEY, F.lit(kind).alias("entity"), "resource_path", F.lit("document cannot be edited").alias("reason")
    )


def plan_token_mode(
    realms: DataFrame,
    clients: DataFrame,
    policies: DataFrame,
    templates=fixed.CLIENT_TEMPLATES,
    mode: str = "lightweight",
    reserved: str = fixed.RESERVED_REALM,
    unchanged: bool = False,
) -> TokenModePlan:
    """Plan the switch to ``mode``; rows that alter nothing are left out unless asked for.

    Tables with a column ``document`` (see ``read_documents``) give bodies of whole documents.
    A row whose document cannot be edited is rejected, never planned with the few fields that
    the other columns have.
    """
    value = MODES[mode]
    tenants = drop_reserved(realms, reserved).select("realm")
    named = drop_reserved(named_by_template(clients, templates), reserved)
    known = first_of_name(named).join(tenants, "realm", "left_semi")
    # The same clients without the nested columns, which the policies do not need.
    flags = first_of_name(named.select("realm", "client_id", "client_uuid", "authz_enabled"))
    with_authz = authz_clients(flags.join(tenants, "realm", "left_semi"))
    theirs = only_found(
        policies_of_type(policies, fixed.ROLE_POLICY), with_authz.select(*CLIENT_KEY), CLIENT_KEY
    )
    keep = F.col("body").isNotNull() & (F.lit(True) if unchanged else F.col("changed"))
    client_rows, policy_rows = patch_clients(known, value), patch_policies(theirs, value)
    return TokenModePlan(
        clients=client_rows.filter(keep),
        policies=policy_rows.filter(keep),
        missing=missing_targets(expand_targets(tenants, templates), named),
        without_policies=with_authz.select(*CLIENT_KEY, "client_id").join(
            theirs.select(*CLIENT_KEY).distinct(), CLIENT_KEY, "left_anti"
        ),
        rejected=_without_body(client_rows, "client").unionByName(_without_body(policy_rows, "policy")),
    )
