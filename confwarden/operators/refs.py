"""From policy documents to reference edges.

A document keeps its references as JSON text inside ``config``.  They are decoded,
cleaned and exploded inside the row: nothing is shuffled until an edge is looked up.
``refs`` carries the number of usable references along, so that a document exported twice
is not counted twice.

Decoding is the expensive part, so no condition is ever put on a decoded list: the
optimizer would move it below the projection and decode a second time to test it.  Lists
are exploded with their empty ones kept, and the conditions are put on the exploded id.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.functions import clean_ids, decode_assoc_ids, decode_role_ids, first_with_ids
from confwarden.session import land, work_folder

POLICY_KEY = ["realm", "client_uuid", "policy_id"]
PERMISSION_KEY = ["realm", "client_uuid", "permission_id"]


def policies_of_type(policies: DataFrame, *types: str) -> DataFrame:
    """A filter the Parquet reader (or partition pruning on ``type``) carries out."""
    return policies.filter(F.col("type").isin(*types))


def flatten_policies(policies: DataFrame, *extra: str) -> DataFrame:
    return policies.select(*POLICY_KEY, "name", *extra)


def with_role_ids(policies: DataFrame) -> DataFrame:
    """Role policies with ``role_ids`` decoded from their configuration."""
    return policies.withColumn(
        "role_ids", decode_role_ids(F.col("config").getItem(fixed.ROLES_KEY))
    )


def with_assoc_ids(permissions: DataFrame) -> DataFrame:
    """Permissions with ``policy_ids`` decoded from their configuration."""
    return permissions.withColumn(
        "policy_ids", decode_assoc_ids(F.col("config").getItem(fixed.ASSOCIATED_KEY))
    )


def has_refs(df: DataFrame, ids: str = "role_ids") -> DataFrame:
    return df.filter(F.size(ids) > 0)


def explode_listed(df: DataFrame, ids: str, into: str) -> DataFrame:
    """One row per reference; a record without any keeps one row, without an id."""
    carried = [c for c in df.columns if c != ids]
    return df.select(
        *carried, F.size(ids).cast("long").alias("refs"), F.explode_outer(ids).alias(into)
    )


def explode_refs(df: DataFrame, ids: str = "role_ids", into: str = "role_id") -> DataFrame:
    """One row per reference; a record without references has none."""
    return explode_listed(df, ids, into).filter(F.col(into).isNotNull())


def complete_role_refs(policies: DataFrame, details: DataFrame) -> DataFrame:
    """References of policies with ``role_ids``; an empty list is taken from the detail.

    The detail record holds the list as text in its configuration or as a plain array; the
    first of these with a usable id counts.  Only policies that lack references are joined,
    so the rest, normally nearly all, is not shuffled.  The narrow edges are landed: both
    sides are taken from there, and the policies are read and decoded once.
    """
    edges = land(explode_listed(policies, "role_ids", "role_id"), work_folder(policies.sparkSession, "role-edges"))
    bare = edges.filter(F.col("role_id").isNull()).drop("refs", "role_id")
    found = details.select(
        *POLICY_KEY,
        first_with_ids(
            decode_role_ids(F.col("config").getItem(fixed.ROLES_KEY)),
            clean_ids(F.col("roles").getField("id")),
        ).alias("role_ids"),
    )
    filled = explode_refs(bare.join(found, POLICY_KEY))
    return edges.filter(F.col("role_id").isNotNull()).unionByName(filled.select(*edges.columns))


def complete_assoc_refs(permissions: DataFrame, associations: DataFrame) -> DataFrame:
    """Associations of permissions with ``policy_ids``; an empty list is taken from the
    association table.

    That table holds edges, which are not collected into lists, so ``refs`` is left for
    the verdict to count.  The listed edges are landed, as those of roles are.
    """
    edges = land(
        explode_listed(permissions, "policy_ids", "policy_id").drop("refs"),
        work_folder(permissions.sparkSession, "assoc-edges"),
    )
    bare = edges.filter(F.col("policy_id").isNull()).drop("policy_id")
    usable = associations.select(*PERMISSION_KEY, "policy_id").filter(
        F.col("policy_id").isNotNull() & (F.col("policy_id") != "")
    )
    filled = usable.join(bare, PERMISSION_KEY)
    return edges.filter(F.col("policy_id").isNotNull()).unionByName(filled.select(*edges.columns))
