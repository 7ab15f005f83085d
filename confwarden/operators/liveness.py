"""Which references still lead somewhere, and which records have none left.

The two verdicts are universally quantified: a policy is dead if it has references and
none of their roles exists, a permission if it has associations and all of them are dead
policies.  Both are expressed as a left join from edges to the set looked up, followed by
a grouping with partial counts.  Arrays of whole sets are never built.

An edge column may have one value in a third of all rows, such as a role everybody
refers to; the lookup join is built for that, and the grouping after it has another key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden.operators.lookup import lookup, only_found
from confwarden.operators.refs import PERMISSION_KEY, POLICY_KEY
from confwarden.operators.roles import ROLE_KEY


def _mark(edges, found, key, flag):
    return lookup(edges, found.select(*key, F.lit(True).alias(flag)), key)


def ref_liveness(refs: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges with ``alive``.  ``roles`` must hold each role once."""
    joined = _mark(refs, roles, ROLE_KEY, "found")
    return joined.select(*refs.columns, F.col("found").isNotNull().alias("alive"))


def ref_counts(refs: DataFrame, roles: DataFrame) -> DataFrame:
    """Per policy: references in total and alive.  ``roles`` must hold each role once."""
    return (
        _mark(refs, roles, ROLE_KEY, "found")
        .groupBy(*POLICY_KEY)
        .agg(F.count("*").alias("total"), F.count("found").alias("alive"))
    )


def _refs(edges):
    """References of a record: what its document says if that is carried, else its edges."""
    return (F.max("refs") if "refs" in edges.columns else F.count("*")).alias("refs")


def dead_policies(refs: DataFrame, roles: DataFrame, *carried: str) -> DataFrame:
    """Policies with references of which none is an existing role.

    Grouped by the key alone, so that a policy exported in two versions is dead only if
    both are; ``carried`` are columns that depend on the key.  Roles may repeat: a repeated
    role only multiplies rows of policies that are alive.
    """
    return (
        _mark(refs, roles, ROLE_KEY, "found")
        .groupBy(*POLICY_KEY, *carried)
        .agg(_refs(refs), F.count("found").alias("alive"))
        .filter(F.col("alive") == 0)
        .drop("alive")
    )


def assoc_deadness(assoc: DataFrame, dead: DataFrame) -> DataFrame:
    """Edges from permissions to policies with ``is_dead``."""
    joined = _mark(assoc, dead, POLICY_KEY, "found")
    return joined.select(*assoc.columns, F.col("found").isNotNull().alias("is_dead"))


def clients_with_findings(dead: DataFrame) -> DataFrame:
    return dead.select("realm", "client_uuid").distinct()


def dead_permissions(
    assoc: DataFrame, dead: DataFrame, *carried: str, prune: bool = False
) -> DataFrame:
    """Permissions with associated policies of which every one is dead.

    ``prune`` first drops the clients without any dead policy.  The result is the same;
    it pays when few clients have findings and ``dead`` is a written table.
    """
    if prune:
        assoc = only_found(assoc, clients_with_findings(dead), ["realm", "client_uuid"])
    return (
        _mark(assoc, dead, POLICY_KEY, "found")
        .groupBy(*PERMISSION_KEY, *carried)
        .agg(_refs(assoc), F.count_if(F.col("found").isNull()).alias("kept"))
        .filter(F.col("kept") == 0)
        .drop("kept")
    )
