"""The catalogue of existing roles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLE_KEY = ["realm", "role_id"]


def all_roles(realm_roles: DataFrame, client_roles: DataFrame) -> DataFrame:
    """Realm and client roles side by side, a role that is both kept twice.

    Enough for verdicts, which only ask whether a role exists, and one shuffle cheaper
    than the distinct catalogue.
    """
    usable = F.col("role_id").isNotNull()
    return (
        realm_roles.select(*ROLE_KEY).unionByName(client_roles.select(*ROLE_KEY)).filter(usable)
    )


def role_catalogue(realm_roles: DataFrame, client_roles: DataFrame) -> DataFrame:
    """Every existing role once."""
    return all_roles(realm_roles, client_roles).dropDuplicates(ROLE_KEY)


def role_count(roles: DataFrame) -> DataFrame:
    """Exact number of distinct roles per tenant.

    Spark plans the distinct count as a grouping by (realm, role) below one by realm, so
    a tenant with most of the roles is spread over all tasks.
    """
    return roles.groupBy("realm").agg(F.countDistinct("role_id").alias("n"))
