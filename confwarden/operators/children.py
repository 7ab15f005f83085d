"""Insert-if-absent and create-or-patch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parents_lacking(children: DataFrame, parent: list[str], is_child) -> DataFrame:
    """Parents none of whose child rows satisfies ``is_child``.

    One pass over the children with partial counts; no self join.
    """
    return (
        children.groupBy(*parent)
        .agg(F.count_if(is_child).alias("n"))
        .filter(F.col("n") == 0)
        .select(*parent)
    )


def missing_children(parents: DataFrame, children: DataFrame, key: list[str]) -> DataFrame:
    """Parents without a row in ``children``, which holds only children of the wanted name."""
    return parents.join(children.select(*key).distinct(), key, "left_anti")


def merge_by_key(desired: DataFrame, existing: DataFrame, key: list[str], differs) -> DataFrame:
    """Full outer merge with ``action``: create, patch where ``differs``, else noop.

    ``differs`` is a condition over columns of ``existing``.  Both sides hold a key once.
    """
    wanted = desired.withColumn("wanted", F.lit(True))
    held = existing.withColumn("held", F.lit(True)).withColumn(
        "differs", F.coalesce(differs, F.lit(False))
    )
    action = (
        F.when(F.col("held").isNull(), "create")
        .when(F.col("wanted").isNotNull() & F.col("differs"), "patch")
        .otherwise("noop")
    )
    return (
        wanted.join(held, key, "full_outer")
        .withColumn("action", action)
        .drop("wanted", "held", "differs")
    )


def grant_missing(holders: DataFrame, held: DataFrame, holder: list[str], roles) -> DataFrame:
    """Grant rows ``roles`` adds to what each of ``holders`` holds already."""
    listed = F.array(*[F.lit(r) for r in roles])
    wanted = holders.select(*holder, F.explode(listed).alias("role"))
    key = [*holder, "role"]
    return wanted.join(held.select(*key).distinct(), key, "left_anti")
