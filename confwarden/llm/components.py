"""Connected components of a link table, without bringing it to one place."""

from pyspark.sql import functions as F

from confwarden.session import land, work_folder


def _lowest(edges):
    """The least neighbour of each node, landed so that a hot node's join can be split."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _star(spark, edges, large):
    """One contraction step: hang neighbours on the least one.

    ``large``: every neighbour above the node is linked to the least neighbour or the node
    itself.  Else the node and its neighbours below are linked to the least of them.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = land(_lowest(both).withColumn("m", F.least("u", "m")), work_folder(spark, "least"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return land(out.where("u <> v").distinct(), work_folder(spark, "star"))


def components(spark, edges, rounds=60):
    """``node, component`` (its least node) for every node of ``edges`` (two id columns).

    Alternates two star contractions until nothing changes; each moves only the link table,
    sums before it shuffles, and needs a number of rounds that grows with the logarithm of
    the longest chain.  No links give no rows; null ids are no nodes.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = land(edges, work_folder(spark, "links"))
    state = None
    for _ in range(rounds):
        edges = _star(spark, _star(spark, edges, True), False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.union(roots)
