"""Cutting findings into batches, and pages of a result."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confwarden.sinks.folders import replace

SLICE_DIGITS = 2


def number_batches(
    findings: DataFrame, group: list[str], order: str, size: int, digits: int = SLICE_DIGITS
) -> DataFrame:
    """``batch_no`` from 0 within each ``group``; every batch but its last has ``size`` rows.

    One client may own most findings, so a group is not numbered by one task.  It is cut
    by the first ``digits`` hexadecimal digits of a digest of ``order`` into slices
    (at most 16 ** digits); rows are numbered inside their slice, and a slice starts
    where those before it end.  The numbering is by slice, then by ``order``, and so is a
    function of the data alone.
    """
    sliced = findings.withColumn(
        "slice", F.substring(F.md5(F.col(order).cast("string")), 1, digits)
    )
    key = [*group, "slice"]
    inside = Window.partitionBy(*key).orderBy(order)
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    position = F.col("start") + F.row_number().over(inside) - 1
    return (
        sliced.join(starts, key)
        .withColumn("batch_no", F.floor(position / size).cast("long"))
        .drop("slice", "start")
    )


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in a total order, for a user to look at."""
    return df.orderBy(*order).offset(offset).limit(limit)


def write_pages(df: DataFrame, order: list[str], path: str, ranges: int = 64) -> None:
    """Write ``df`` in ranges of its total order, and how many rows each range has.

    Spark samples the boundaries, so a range that grows with the table wants more ``ranges``.
    """
    dealt = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    replace(dealt, f"{path}/rows", "range")
    spark = df.sparkSession
    written = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    replace(written.groupBy("range").agg(F.count("*").alias("n")), f"{path}/index")


def read_page(spark: SparkSession, path: str, schema, order: list[str], offset: int, limit: int) -> DataFrame:
    """The same rows as ``page`` of the written table, from the few ranges that hold them.

    The index has a row for each range; its running sum says where a range begins.  Other
    ranges are not read, and what is sorted does not grow with the offset.
    """
    index = spark.read.schema("range int, n long").parquet(f"{path}/index").orderBy("range").collect()
    begin, first, wanted = 0, None, []
    for r in index:
        if begin < offset + limit and begin + r.n > offset:
            first = begin if first is None else first
            wanted.append(r.range)
        begin += r.n
    ranged = T.StructType([*schema.fields, T.StructField("range", T.IntegerType())])
    rows = spark.read.schema(ranged).parquet(f"{path}/rows")
    rows = rows.filter(F.col("range").isin(wanted)).drop("range")
    return page(rows, order, offset - (first or 0), limit)
