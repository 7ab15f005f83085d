"""Plan and findings tables."""

from pyspark.sql import DataFrame


def write_plan(plan: DataFrame, path: str, mode: str = "append") -> None:
    """Write plan rows, laid out by tenant.

    The rebalance hint brings a tenant's rows together, so that each task does not open a
    file for every tenant, and still splits a tenant that holds most of them.
    """
    plan.hint("rebalance", "realm").write.mode(mode).partitionBy("realm").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write what one micro-batch produced; replaying the batch replaces it."""
    df.hint("rebalance").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
