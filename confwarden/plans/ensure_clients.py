"""Create the wanted service-account clients or bring existing ones into line."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.functions import has_mapper, insert_mapper, map_upsert
from confwarden.operators.children import merge_by_key
from confwarden.operators.clients import NAME_KEY
from confwarden.plans.token_mode import mapper_documents


def ensure_clients(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Plan rows for ``desired`` (realm, client_id) against ``existing`` clients.

    A new client gets the mode attribute, the realm-roles mapper and its role grants.  An
    existing one gets attribute and mapper if they are missing, but no grants.  Clients
    that exist and are not wanted come out as ``noop``.  Names match exactly.
    """
    attribute = F.col("attributes").getItem(fixed.TOKEN_MODE_ATTRIBUTE)
    set_attribute = ~attribute.eqNullSafe(F.lit("true"))
    add_mapper = ~has_mapper(F.col("protocol_mappers"), fixed.REALM_ROLES_MAPPER["name"])
    merged = merge_by_key(
        desired.select(*NAME_KEY),
        existing.select(*NAME_KEY, "client_uuid", "attributes", "protocol_mappers"),
        NAME_KEY,
        set_attribute | add_mapper,
    )

    creates = F.col("action") == "create"
    touches = F.col("action") != "noop"
    attributes = map_upsert(F.col("attributes"), fixed.TOKEN_MODE_ATTRIBUTE, "true")
    mappers = mapper_documents(insert_mapper(F.col("protocol_mappers"), fixed.REALM_ROLES_MAPPER))
    created = F.struct(
        F.col("client_id").alias("clientId"),
        F.lit(True).alias("serviceAccountsEnabled"),
        F.lit(False).alias("publicClient"),
        F.lit(fixed.CLIENT_AUTHENTICATOR).alias("clientAuthenticatorType"),
        F.lit(False).alias("standardFlowEnabled"),
        attributes.alias("attributes"),
        mappers.alias("protocolMappers"),
    )
    patched = F.struct(
        F.col("client_uuid").alias("id"),
        F.col("client_id").alias("clientId"),
        attributes.alias("attributes"),
        mappers.alias("protocolMappers"),
    )
    grants = F.when(creates, F.array(*[F.lit(r) for r in fixed.GRANTED_ROLES]))
    account = F.concat(F.lit(fixed.SERVICE_ACCOUNT_PREFIX), F.col("client_id"))
    return merged.select(
        *NAME_KEY,
        "client_uuid",
        "action",
        (touches & set_attribute).alias("set_attribute"),
        (touches & add_mapper).alias("add_mapper"),
        F.when(creates, account).alias("username"),
        F.coalesce(grants, F.array().cast("array<string>")).alias("grants"),
        F.when(creates, F.to_json(created))
        .when(touches, F.to_json(patched))
        .alias("body"),
    )
