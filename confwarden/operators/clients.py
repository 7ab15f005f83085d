"""Choosing tenants and clients, and finding clients by name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.functions import expand_template
from confwarden.operators.lookup import not_found, only_found

CLIENT_KEY = ["realm", "client_uuid"]
NAME_KEY = ["realm", "client_id"]


def drop_reserved(df: DataFrame, reserved: str = fixed.RESERVED_REALM) -> DataFrame:
    """The reserved tenant is never touched, not even if it is a target."""
    return df.filter(F.col("realm") != reserved)


def only_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """Rows of the target tenants; an empty list means all tenants."""
    return df.filter(F.col("realm").isin(*targets)) if targets else df


def matching_clients(df: DataFrame, pattern: str = fixed.CLIENT_PATTERN) -> DataFrame:
    """Regular-expression search, not a whole match, in the client id."""
    return df.filter(F.col("client_id").rlike(pattern))


def authz_clients(df: DataFrame) -> DataFrame:
    """Clients with the flag set; null does not count."""
    return df.filter(F.col("authz_enabled"))


def split_by_authz(df: DataFrame) -> DataFrame:
    """All clients with ``status``: ``process`` for the flag set, else ``skipped``."""
    on = F.coalesce(F.col("authz_enabled").cast("string") == "true", F.lit(False))
    return df.withColumn("status", F.when(on, "process").otherwise("skipped"))


def clients_in_scope(
    clients: DataFrame, pattern: str, targets: list[str], reserved: str
) -> DataFrame:
    scope = drop_reserved(only_targets(clients, targets), reserved)
    return authz_clients(matching_clients(scope, pattern))


def pending(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has not been done.  The done side is reduced to distinct keys first."""
    return not_found(df, done.select(*key).distinct(), key)


def needs_patch(
    df: DataFrame, attribute: str = fixed.TOKEN_MODE_ATTRIBUTE, value: str = "true"
) -> DataFrame:
    """Clients whose attribute differs from ``value``; an absent attribute differs."""
    return df.filter(~F.col("attributes").getItem(attribute).eqNullSafe(F.lit(value)))


# Named targets -------------------------------------------------------------------
def expand_targets(realms: DataFrame, templates: list[str]) -> DataFrame:
    """Every tenant with every client template.

    The templates are a job parameter, so they are exploded from a literal array within
    each tenant's row instead of being joined.
    """
    listed = F.array(*[F.lit(t) for t in templates])
    return realms.select("realm", F.explode(listed).alias("template")).select(
        "realm", expand_template(F.col("realm"), F.col("template")).alias("client_id")
    )


def named_by_template(clients: DataFrame, templates: list[str]) -> DataFrame:
    """Clients some template names in their own tenant.

    Equals joining with the expanded targets but is decided inside the row: the client
    table, the only large one here, is not shuffled for it.
    """
    names = [expand_template(F.col("realm"), F.lit(t)) for t in templates]
    return clients.filter(F.col("client_id").isin(*names))


def first_of_name(clients: DataFrame) -> DataFrame:
    """One client per name: the lowest ``client_uuid``, with all its columns.

    An aggregation, not a window: copies of a name are reduced before the shuffle.
    """
    rest = [c for c in clients.columns if c not in NAME_KEY]
    return (
        clients.groupBy(*NAME_KEY)
        .agg(F.min_by(F.struct(*rest), "client_uuid").alias("first"))
        .select(*NAME_KEY, "first.*")
        .select(*clients.columns)
    )


def lookup_client(targets: DataFrame, clients: DataFrame) -> DataFrame:
    """Targets with the client of exactly that name in that tenant.

    Clients that are no target are left out before anything is grouped.
    """
    named = only_found(clients.select(*NAME_KEY, "client_uuid"), targets.select(*NAME_KEY), NAME_KEY)
    firsts = named.groupBy(*NAME_KEY).agg(F.min("client_uuid").alias("client_uuid"))
    return targets.join(firsts, NAME_KEY)


def missing_targets(targets: DataFrame, clients: DataFrame) -> DataFrame:
    """Targets no client answers to."""
    return targets.join(clients.select(*NAME_KEY).distinct(), NAME_KEY, "left_anti")
