"""Exports stamped with the snapshot they belong to; a verdict uses one snapshot of each tenant.

Exports overlap: the next one begins to arrive before the last has arrived in full, and roles
of one next to policies of another would make live policies look dead.  Every row of every
entity carries a ``snapshot_id``, and the manifest announces counts by snapshot.
"""

from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden.operators.lookup import only_found
from confwarden.sources.guard import ENTITY_KEYS

SNAPSHOT = "snapshot_id"


def stamped(df: DataFrame, snapshot) -> DataFrame:
    """``df`` as part of a snapshot; ids sort in the order in which snapshots were taken."""
    return df.withColumn(SNAPSHOT, F.lit(snapshot))


def snapshot_counts(entities: dict[str, DataFrame]) -> DataFrame:
    """``realm, snapshot_id, entity, actual``: distinct ids that have arrived.

    Spark groups them by tenant, snapshot and id before it counts, so one large tenant is
    spread over all tasks.
    """

    def delivered(name):
        n = F.countDistinct(*ENTITY_KEYS[name]).alias("actual")
        return entities[name].groupBy("realm", SNAPSHOT).agg(n).withColumn("entity", F.lit(name))

    return reduce(DataFrame.unionByName, map(delivered, entities))


def whole_snapshots(manifest: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """``realm, snapshot_id`` of the snapshots that announce every entity and have it in full."""
    counted = manifest.join(snapshot_counts(entities), ["realm", SNAPSHOT, "entity"], "left")
    good = F.col("expected") == F.coalesce("actual", F.lit(0))
    return (
        counted.filter(F.col("entity").isin(*entities))
        .groupBy("realm", SNAPSHOT)
        .agg(F.countDistinct(F.when(good, F.col("entity"))).alias("whole"), F.count_if(~F.coalesce(good, F.lit(False))).alias("broken"))
        .filter((F.col("whole") == len(entities)) & (F.col("broken") == 0))
        .select("realm", SNAPSHOT)
    )


def newest(snapshots: DataFrame, at=None) -> DataFrame:
    """The last of a tenant's snapshots, or the last that is not later than ``at``."""
    if at is not None:
        snapshots = snapshots.filter(F.col(SNAPSHOT) <= at)
    return snapshots.groupBy("realm").agg(F.max(SNAPSHOT).alias(SNAPSHOT))


def as_of(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen snapshot of each tenant, still stamped."""
    return only_found(df, chosen.select("realm", SNAPSHOT), ["realm", SNAPSHOT])


def entities_as_of(entities, manifest: DataFrame, at=None):
    """Entities (see ``plans.audit``) with the newest whole snapshot of each tenant, and which it is.

    Tenants without a whole snapshot have no rows in the result.
    """
    names = {"clients": "client", "roles": "role", "policies": "policy", "details": "policy_detail", "associations": "permission_assoc"}
    given = {f: getattr(entities, f) for f in names if getattr(entities, f) is not None}
    chosen = newest(whole_snapshots(manifest, {names[f]: df for f, df in given.items()}), at)
    taken = {f: as_of(df, chosen) for f, df in given.items()}
    realms = entities.realms.join(chosen.select("realm"), "realm", "left_semi")
    return replace(entities, realms=realms, **taken), chosen


def mixtures(entities) -> DataFrame:
    """``realm, entity, snapshots`` wherever a tenant's rows are not all of one snapshot.

    For entities with a ``snapshot_id``; the job that gets them leaves such tenants out.
    """
    parts = []
    for field in fields(entities):
        df = getattr(entities, field.name)
        if isinstance(df, DataFrame) and SNAPSHOT in df.columns:
            parts.append(df.select("realm", F.lit(field.name).alias("entity"), F.col(SNAPSHOT)).distinct())
    if not parts:
        return entities.realms.select("realm", F.lit("").alias("entity"), F.lit(0).cast("long").alias("snapshots")).limit(0)
    stamps = reduce(DataFrame.unionByName, parts)
    mixed = stamps.groupBy("realm").agg(F.countDistinct(SNAPSHOT).alias("n")).filter("n > 1")
    each = stamps.groupBy("realm", "entity").agg(F.count(F.lit(1)).alias("snapshots"))
    return each.join(mixed.select("realm"), "realm", "left_semi")
