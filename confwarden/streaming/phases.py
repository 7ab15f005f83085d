"""The audit over export pages that keep arriving.

Each phase is one query that takes whatever pages are new and stops.  A micro-batch only
lands its records with their lists decoded, under its own number, and only then does the
checkpoint move on: a crash replays the batch, which replaces what it had written.  Scope,
details and associations are whole tables, so they are not joined to each micro-batch but to
all new records at once, when the pages have been read: the references and the ledger rows of
the run are written under the number of its last batch, the ledger last.  A run broken off
in between is settled by the next one, before that reads pages.  Clients, roles
and associations are joined by shuffles, so that what goes through the driver does not grow with them.
The verdict comes at the end of a run, over all references landed so far: a later version
of a policy can revive it, and policies may arrive after the permissions that need them.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confwarden import fixed, schemas
from confwarden.operators.clients import CLIENT_KEY
from confwarden.operators.liveness import dead_permissions, dead_policies
from confwarden.operators.lookup import only_found, whole
from confwarden.operators.refs import POLICY_KEY, policies_of_type, with_assoc_ids, with_role_ids
from confwarden.operators.batches import number_batches
from confwarden.plans.audit import all_findings, delete_plan, listed_permission_edges, listed_role_edges
from confwarden.session import land, work_folder
from confwarden.sinks.folders import last_written, replace
from confwarden.sinks.tables import write_batch


def page_stream(
    spark: SparkSession, entity: str, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """New export pages of ``entity``; a file with a bad line fails its batch."""
    reader = spark.readStream.schema(schemas.EXPORTS[entity]).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything the micro-batches have written."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def _ledger_rows(records: DataFrame, clients: DataFrame, run_id: str, phase) -> DataFrame:
    counted = records.groupBy(*CLIENT_KEY, phase.alias("phase")).agg(F.count("*").alias("offset"))
    return only_found(counted, clients, CLIENT_KEY).select(
        F.lit(run_id).alias("run_id"),
        *CLIENT_KEY,
        "phase",
        "offset",
        F.lit("read").alias("status"),
        F.current_timestamp().alias("ts"),
    )


def _run_phase(
    pages: DataFrame,
    decode: Callable[[DataFrame], DataFrame],
    edges_of: Callable[[DataFrame], DataFrame],
    clients: DataFrame,
    out: str,
    folder: str,
    run_id: str,
    phase,
) -> DataFrame:
    spark = pages.sparkSession
    landed, ledger = f"{folder}/landed/{out}", f"{folder}/ledger/{out}"
    scope, schema = whole(clients.select(*CLIENT_KEY)), decode(pages).schema

    def settle() -> int:
        """Write references and ledger rows of all landed batches without; the last batch that has them."""
        first, last = last_written(spark, ledger, "batch_id") + 1, last_written(spark, landed, "batch_id")
        if last >= first:
            new = [f"{landed}/batch_id={n}" for n in range(first, last + 1)]
            records = spark.read.schema(schema).parquet(*new)
            replace(edges_of(only_found(records, scope, CLIENT_KEY)), f"{folder}/{out}/batch_id={last}")
            write_batch(_ledger_rows(records, scope, run_id, phase), ledger, last)
        return max(first - 1, last)

    settled = settle()

    def batch(page: DataFrame, batch_id: int) -> None:
        if batch_id > settled:
            replace(decode(page), f"{landed}/batch_id={batch_id}")

    (
        pages.writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{folder}/checkpoints/{out}")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    settle()
    empty = spark.createDataFrame([], schema)
    return read_batches(spark, f"{folder}/{out}", edges_of(empty).schema)


def _role_records(page: DataFrame) -> DataFrame:
    mine = policies_of_type(page, fixed.ROLE_POLICY).select(*POLICY_KEY, "config")
    return with_role_ids(mine).drop("config")


def _permission_records(page: DataFrame) -> DataFrame:
    mine = policies_of_type(page, *fixed.PERMISSION_TYPES).select(
        *CLIENT_KEY, F.col("policy_id").alias("permission_id"), "type", "config"
    )
    return with_assoc_ids(mine).drop("config")


def stream_dead_policies(
    pages: DataFrame,
    clients: DataFrame,
    roles: DataFrame,
    folder: str,
    run_id: str,
    details: DataFrame | None = None,
) -> DataFrame:
    """Phase 1: lands the new pages' references; returns what is dead by all landed so far.

    ``clients`` and ``roles`` are tables of the same snapshot.  A policy exported in two
    versions is dead only if both are, and comes out once.
    """
    edges = _run_phase(
        pages,
        _role_records,
        lambda records: listed_role_edges(records, details),
        clients,
        "dead_policy",
        folder,
        run_id,
        F.lit(fixed.POLICY_PHASE),
    )
    return dead_policies(edges, whole(roles))


def stream_dead_permissions(
    pages: DataFrame,
    clients: DataFrame,
    dead: DataFrame,
    folder: str,
    run_id: str,
    associations: DataFrame | None = None,
) -> DataFrame:
    """Phases 2-scope and 2-resource; returns what ``dead`` leaves of all landed so far.

    Call it again with the dead policies of a later run, with or without new pages: the
    permissions of earlier runs are judged anew.  ``dead`` is read twice, so it should be a
    written table.
    """
    phase = F.when(F.col("type") == "scope", fixed.PERMISSION_PHASES["scope"]).otherwise(
        fixed.PERMISSION_PHASES["resource"]
    )
    linked = None if associations is None else whole(associations)
    edges = _run_phase(
        pages,
        _permission_records,
        lambda records: listed_permission_edges(records, linked),
        clients,
        "dead_permission",
        folder,
        run_id,
        phase,
    )
    return dead_permissions(edges, dead, "type", prune=True)


def stream_plan(
    policies: DataFrame, permissions: DataFrame, batch_size: int = fixed.BATCH_SIZE, dry_run: bool = True
) -> DataFrame:
    """The delete plan of both phases' verdicts, with its batches; replace an earlier run's."""
    # Numbering reads its rows twice; the verdicts behind them are worked out once.
    findings = land(all_findings(policies, permissions), work_folder(policies.sparkSession, "stream-findings"))
    planned = delete_plan(findings, dry_run)
    return number_batches(planned, [*CLIENT_KEY, "phase"], "target_id", batch_size)
