"""Session settings and the shared work folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="confwarden", master=None, **conf):
    """A session with the settings the jobs are written for.

    Shuffle partitions start high and adaptive execution merges small ones; the same
    mechanism splits skewed join partitions and turns joins into broadcasts once the
    real size of a side is known.  The broadcast limit stays at Spark's own default.
    Where every partition of a shuffled side is measured to be small, the join hashes it
    and the large side need not be sorted.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark, name):
    """A new folder, visible to every executor, for tables kept between phases.

    It lies below ``spark.checkpoint.dir``.  Only a local session may do without that
    setting: a machine-local folder on a cluster would be lost with its machine.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="confwarden-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def land(df, path):
    """Write ``df`` as Parquet and return the written table.

    Cuts lineage between phases, survives the loss of executors, and lets several
    consumers read one result instead of computing it again.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
