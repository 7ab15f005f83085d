"""The run ledger: what has been done, and how far."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden import schemas
from confwarden.functions import cursor_text
from confwarden.sinks.folders import last_written, replace


def done_rows(df: DataFrame, run_id: str, ts, phase: str | None = None) -> DataFrame:
    """Ledger rows saying that each row of ``df`` is done.

    ``df`` has ``realm`` and, unless whole tenants are meant, ``client_uuid``.
    """
    client = F.col("client_uuid") if "client_uuid" in df.columns else F.lit(None)
    return df.select(
        F.lit(run_id).alias("run_id"),
        "realm",
        client.cast("string").alias("client_uuid"),
        F.lit(phase).cast("string").alias("phase"),
        F.lit(None).cast("long").alias("offset"),
        F.lit("done").alias("status"),
        ts.cast("timestamp").alias("ts"),
    )


def append_ledger(rows: DataFrame, path: str) -> DataFrame:
    """Append and return the whole ledger."""
    names = schemas.RUN_LEDGER.fieldNames()
    rows.select(*names).hint("rebalance").write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(schemas.RUN_LEDGER).parquet(path)


def read_ledger(spark, path: str) -> DataFrame:
    """What ``record_run`` has kept: the last compact table and the runs since."""
    whole = last_written(spark, f"{path}/compact", "upto")
    paths = [f"{path}/compact/upto={whole}"] if whole >= 0 else []
    paths += [f"{path}/runs/run={n}" for n in range(whole + 1, last_written(spark, f"{path}/runs", "run") + 1)]
    if not paths:
        return spark.createDataFrame([], schemas.RUN_LEDGER)
    return spark.read.schema(schemas.RUN_LEDGER).parquet(*paths)


def record_run(rows: DataFrame, path: str, every: int = 16) -> DataFrame:
    """Add a run's rows to the ledger below ``path`` and return the whole ledger.

    Every so many runs the ledger is written anew as one compact table: of rows of one tenant,
    client, phase and status the latest, with offsets added up.  So a thousand runs over the
    same clients are read as one table of them and a short tail.  One writer at a time; an
    attempt that broke off is replaced by the next.
    """
    spark, names = rows.sparkSession, schemas.RUN_LEDGER.fieldNames()
    run = last_written(spark, f"{path}/runs", "run") + 1
    replace(rows.select(*names).hint("rebalance"), f"{path}/runs/run={run}")
    if run - last_written(spark, f"{path}/compact", "upto") >= every:
        replace(compacted(read_ledger(spark, path)).hint("rebalance"), f"{path}/compact/upto={run}")
    return read_ledger(spark, path)


def compacted(ledger: DataFrame) -> DataFrame:
    """One row for each tenant, client, phase and status: the latest run, all offsets."""
    latest = F.max(F.struct("ts", "run_id")).alias("latest")
    return (
        ledger.groupBy("realm", "client_uuid", "phase", "status")
        .agg(F.sum("offset").alias("offset"), latest)
        .select("latest.run_id", "realm", "client_uuid", "phase", "offset", "status", "latest.ts")
    )


def cursors(ledger: DataFrame) -> DataFrame:
    """How many records of each client and phase have been read, also as cursor text.

    Each batch adds its own rows, so the position is their sum.
    """
    return (
        ledger.filter(F.col("status") == "read")
        .groupBy("realm", "client_uuid", "phase")
        .agg(F.sum("offset").alias("offset"))
        .withColumn("cursor", cursor_text(F.col("phase"), F.col("offset")))
    )


def unseen(plan: DataFrame, written: DataFrame, key: str = "resource_path") -> DataFrame:
    """Plan rows not written before, each once, so a replay adds nothing."""
    return plan.dropDuplicates([key]).join(written.select(key).distinct(), key, "left_anti")
