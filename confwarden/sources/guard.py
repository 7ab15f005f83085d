"""Completeness of an export.

A role that is missing from the export only because a listing failed would make live
policies look dead.  A tenant is therefore audited only if every entity it announces
has arrived in full.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY_KEYS = {
    "client": ["client_uuid"],
    "role": ["role_id"],
    "policy": ["client_uuid", "policy_id"],
    "policy_detail": ["client_uuid", "policy_id"],
    "permission_assoc": ["client_uuid", "permission_id", "policy_id"],
}


def incomplete_exports(manifest: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """``realm, entity, expected, actual`` of everything that did not arrive in full.

    Distinct ids are counted, so that a page exported twice cannot stand in for one that
    is missing.  Spark groups them by tenant and id before it counts by tenant: a tenant
    with most of the rows is spread over all tasks.
    """

    def delivered(name):
        n = F.countDistinct(*ENTITY_KEYS[name]).alias("actual")
        return entities[name].groupBy("realm").agg(n).withColumn("entity", F.lit(name))

    counts = reduce(DataFrame.unionByName, map(delivered, entities))
    return (
        manifest.join(counts, ["realm", "entity"], "left")
        .select("realm", "entity", "expected", F.coalesce("actual", F.lit(0)).alias("actual"))
        .filter(F.col("expected").isNull() | (F.col("expected") != F.col("actual")))
    )


def rejected_exports(realms: DataFrame, manifest: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """``realm, entity, expected, actual, reason`` of all that keeps tenants of ``realms`` out.

    Each tenant has to announce every one of ``entities``; what it announces and what it does
    not are both listed, so that no tenant is left out without a row that says why.
    """
    names = F.array(*[F.lit(n) for n in entities])
    wanted = realms.select("realm", F.explode(names).alias("entity")).distinct()
    missing = wanted.join(manifest.select("realm", "entity"), ["realm", "entity"], "left_anti").select(
        "*",
        F.lit(None).cast("long").alias("expected"),
        F.lit(None).cast("long").alias("actual"),
        F.lit("not announced").alias("reason"),
    )
    broken = incomplete_exports(manifest, entities).join(realms.select("realm").distinct(), "realm", "left_semi")
    return missing.unionByName(broken.withColumn("reason", F.lit("incomplete")))


def complete_realms(realms: DataFrame, rejected: DataFrame) -> DataFrame:
    """Tenants without a row in ``rejected_exports``."""
    return realms.join(rejected.select("realm").distinct(), "realm", "left_anti")
