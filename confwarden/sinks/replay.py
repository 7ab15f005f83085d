"""What has been planned already: an index of written paths, so that a replay adds nothing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confwarden.operators.lookup import not_found
from confwarden.sinks.folders import is_written, last_written, replace

BUCKETS = 32
INDEX = T.StructType([T.StructField("resource_path", T.StringType()), T.StructField("bucket", T.IntegerType())])


def _bucket():
    return F.pmod(F.xxhash64("resource_path"), F.lit(BUCKETS)).cast("int")


def planned_paths(spark, folder: str, before: int, buckets: list[int] | None = None) -> DataFrame:
    """Paths written by the runs before ``before``: the last compact table and the runs after it."""
    whole = last_written(spark, f"{folder}/index/compact", "upto")
    paths = [f"{folder}/index/compact/upto={whole}"] if whole >= 0 else []
    paths += [f"{folder}/index/runs/run={n}" for n in range(whole + 1, before)]
    out = spark.createDataFrame([], INDEX)
    for path in paths:
        out = out.unionByName(spark.read.schema(INDEX).parquet(path))
    return out if buckets is None else out.filter(F.col("bucket").isin(buckets))


def write_unseen(plan: DataFrame, folder: str, every: int = 8) -> DataFrame:
    """Write the plan rows whose path no earlier run has written, each once; returns these rows.

    Only the buckets of the index into which the new paths fall are read.  Rows are written
    before the index says so, under the number of the run: an attempt that broke off is
    replaced by the next.  ``every`` so many runs the index is written anew as one table.
    """
    spark = plan.sparkSession
    run = last_written(spark, f"{folder}/index/runs", "run") + 1
    rows = plan.dropDuplicates(["resource_path"]).withColumn("bucket", _bucket())
    replace(rows, f"{folder}/candidates/run={run}")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/candidates/run={run}")
    buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
    fresh = not_found(rows, planned_paths(spark, folder, run, buckets).select("resource_path"), ["resource_path"])
    replace(fresh.drop("bucket").hint("rebalance", "realm"), f"{folder}/plan/run={run}", "realm")
    written = spark.read.schema(plan.schema).parquet(f"{folder}/plan/run={run}").select(*plan.columns)
    index = written.select("resource_path").withColumn("bucket", _bucket())
    replace(index.hint("rebalance", "bucket"), f"{folder}/index/runs/run={run}", "bucket")
    compact_index(spark, folder, every)
    return written


def compact_index(spark, folder: str, every: int = 8) -> None:
    """One table of all paths once ``every`` runs have been added since the last."""
    run = last_written(spark, f"{folder}/index/runs", "run")
    if run - last_written(spark, f"{folder}/index/compact", "upto") >= every:
        whole = planned_paths(spark, folder, run + 1)
        replace(whole.hint("rebalance", "bucket"), f"{folder}/index/compact/upto={run}", "bucket")


def all_planned(spark, folder: str, schema: T.StructType) -> DataFrame:
    """Every plan row that has been written."""
    if not is_written(spark, f"{folder}/plan/*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/plan").select(*schema.fieldNames())
