"""Numbered folders of written tables; one counts once its writer has finished."""

from pyspark.sql import DataFrame, SparkSession


def _matches(spark: SparkSession, pattern: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    return [str(found.getPath()) for found in files.globStatus(path) or []]


def is_written(spark: SparkSession, pattern: str) -> bool:
    """Whether a table is there as a whole; ``pattern`` may hold ``*``."""
    return bool(_matches(spark, f"{pattern}/_SUCCESS"))


def last_written(spark: SparkSession, path: str, name: str) -> int:
    """The largest n of the whole tables ``path/name=n``, -1 without any."""
    found = _matches(spark, f"{path}/{name}=*/_SUCCESS")
    return max((int(x.split("/")[-2].split("=")[1]) for x in found), default=-1)


def replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a table, with zstd for its many ids; an earlier attempt at it is replaced."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)
