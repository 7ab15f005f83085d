"""The joins every membership question goes through."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGEST = "key_digest"


def _join(rows, found, key, how):
    for name in key:
        if rows.schema[name].dataType != found.schema[name].dataType:
            raise TypeError(f"{name} has different types on the two sides")
    digest = F.xxhash64(*key)
    left, right = rows.withColumn(DIGEST, digest), found.withColumn(DIGEST, digest)
    return left.join(right, [DIGEST, *key], how).drop(DIGEST)


def whole(found: DataFrame) -> DataFrame:
    """``found`` as a table that grows with the export: joined by shuffles, never broadcast.

    Spark tells a small table by its files, and ids are 15 to 25 times as large in the memory
    of a broadcast as in compressed Parquet.  Clients or roles in files of 8 MB went through
    the driver as 130 to 210 MB, once for each join.
    """
    return found.hint("merge")


def lookup(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Left outer join of many ``rows`` to a set ``found``, safe for a hot key.

    A small ``found`` is broadcast by Spark's own size check and ``rows`` stay where they
    are.  Beyond that size both sides are shuffled, and adaptive execution splits a
    partition of ``rows`` that one key has made too large.  It can only do so if the join
    sits on two shuffles of its own, and if no later step relies on how the join leaves
    its output partitioned.  Both are seen to by adding a digest of the key: a ``found``
    that was just grouped by the key is shuffled once more, and so is a result that is
    grouped by it.  The digest comes first: a number that nearly always differs is cheaper to
    compare than tenant names, which have few values and often one prefix.
    """
    return _join(rows, found, key, "left")


def only_found(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is in ``found``, by the same kind of join: one client may own a
    third of all policies."""
    return _join(rows, found, key, "left_semi")


def not_found(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not in ``found``: one tenant may own a third of all clients."""
    return _join(rows, found, key, "left_anti")
