"""A flag that stays set for the rest of a session once any request has carried it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden.operators.lookup import lookup


def first_flagged(requests: DataFrame, session: str, order: list[str], flag) -> DataFrame:
    """Per session, where in ``order`` the flag first appears."""
    return (
        requests.filter(flag)
        .groupBy(session)
        .agg(F.min(F.struct(*order)).alias("since"))
    )


def sticky_flag(requests: DataFrame, session: str, order: list[str], flag) -> DataFrame:
    """Requests with ``flag``: true from the first flagged request of the session on.

    The earliest flagged position is an aggregate with partial minima, looked up by every
    request.  A running window would put a session that holds most requests through one
    task.
    """
    since = first_flagged(requests, session, order, flag)
    return (
        lookup(requests, since, [session])
        .withColumn(
            "flag", F.coalesce(F.struct(*order) >= F.col("since"), F.lit(False))
        )
        .drop("since")
    )
