"""The sticky flag over a stream, in order of arrival.

The state is a table with one row per flagged session.  A micro-batch adds the sessions
it flags for the first time and reads what earlier batches have added, so it can be
replayed.  Within a batch this is the batch operator: a session that sends most requests
is spread over tasks, where a per-key state processor would put it through one.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confwarden.operators.lookup import lookup
from confwarden.operators.sticky import first_flagged
from confwarden.sinks.tables import write_batch
from confwarden.streaming.phases import read_batches


def stream_sticky_flag(
    requests: DataFrame, session: str, order: list[str], flag, folder: str
) -> DataFrame:
    """Consume the new requests; returns all requests so far with their ``flag``."""
    spark = requests.sparkSession
    out, state, checkpoint = (f"{folder}/{name}" for name in ("flagged", "sessions", "checkpoint"))
    key = T.StructType([requests.schema[session]])
    state_schema = T.StructType([*key.fields, T.StructField("batch_id", T.LongType())])
    out_schema = T.StructType([*requests.schema.fields, T.StructField("flag", T.BooleanType())])

    def batch(rows: DataFrame, batch_id: int) -> None:
        if batch_id:
            earlier = spark.read.schema(state_schema).parquet(state)
            known = earlier.filter(F.col("batch_id") < batch_id).select(session).distinct()
        else:
            known = spark.createDataFrame([], key)
        since = first_flagged(rows, session, order, flag)
        fresh = since.join(known, session, "left_anti")
        position = F.struct(*order)
        sessions = known.select(session, F.lit(True).alias("known"), F.lit(None).alias("since"))
        sessions = sessions.unionByName(fresh.select(session, F.lit(False).alias("known"), "since"))
        flagged = lookup(rows, sessions, [session]).withColumn(
            "flag",
            F.coalesce(F.col("known") | (position >= F.col("since")), F.lit(False)),
        )
        write_batch(flagged.select(*out_schema.fieldNames()), out, batch_id)
        write_batch(fresh.select(session), state, batch_id)

    (
        requests.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return read_batches(spark, out, out_schema)
