"""Target tenants given as comma-separated text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden.functions import trim_space


def target_list(text: str | None) -> list[str]:
    """The job parameter: trimmed, without blanks, each name once, in first-seen order.

    It becomes a literal ``IN`` list, which prunes partitions of the scanned tables.
    """
    names = (name.strip() for name in (text or "").split(","))
    return list(dict.fromkeys(name for name in names if name))


def explode_targets(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The same for a column of such lists: one row per list and distinct tenant.

    ``pos`` is where the tenant was first seen.  Duplicates within a list vanish inside
    the row, so the rows are not shuffled.
    """
    names = F.filter(
        F.transform(F.split(F.col(text), ","), trim_space), lambda x: x != F.lit("")
    )
    return df.select(
        *keys, F.posexplode(F.array_distinct(names)).alias("pos", "realm")
    )


def unknown_targets(realms: DataFrame, targets: list[str]) -> list[str]:
    """The names of ``targets`` that no tenant has; what comes back is bounded by the list."""
    if not targets:
        return []
    known = {r.realm for r in realms.filter(F.col("realm").isin(targets)).select("realm").distinct().collect()}
    return [name for name in targets if name not in known]
