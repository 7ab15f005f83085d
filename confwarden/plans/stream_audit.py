"""The audit over export folders that keep growing: each call takes in what is new.

Pages of policies, details and associations are read once, by streaming checkpoints below the
state folder; clients, roles and tenants are read as they are now.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from confwarden.operators.batches import number_batches
from confwarden.operators.clients import CLIENT_KEY
from confwarden.operators.counts import findings_by_client
from confwarden.operators.lookup import not_found
from confwarden.plans.audit import AuditConfig, Entities, all_findings, delete_plan, scope_of
from confwarden.session import land
from confwarden.sinks.folders import last_written
from confwarden.sinks.replay import planned_paths, write_unseen
from confwarden.streaming.incremental import (
    advance_permissions,
    advance_policies,
    dead_permissions_of,
    dead_policies_of,
    pending_records,
    permission_state,
    policy_state,
)


@dataclass(frozen=True)
class StreamAudit:
    """``plan`` has the rows that no applied run has planned; ``pending`` what waits for details."""

    run: int
    clients: DataFrame
    findings: DataFrame
    counts: DataFrame
    plan: DataFrame
    pending: DataFrame


def stream_audit(
    spark: SparkSession,
    entities: Entities,
    folder: str,
    config: AuditConfig = AuditConfig(),
) -> StreamAudit:
    """Advance both phases by the new pages and return the findings of the clients in scope now.

    ``entities.policies``, ``details`` and ``associations`` are streams (``page_stream``), the
    others tables.  An applied run adds its plan rows to ``folder/planned`` and their paths to
    the index there; a dry run shows the rows that an applied one would add.
    """
    policies, permissions = policy_state(spark, folder), permission_state(spark, folder)
    run = advance_policies(policies, entities.roles, entities.policies, entities.details)
    advance_permissions(permissions, dead_policies_of(policies, None), entities.policies, entities.associations)
    results = f"{folder}/results/run={run}"
    _, clients, _ = scope_of(entities, config, results)
    clients = land(clients, f"{results}/client")
    dead = dead_policies_of(policies, clients)
    findings = land(all_findings(dead, dead_permissions_of(permissions, clients)), f"{results}/findings")
    planned = delete_plan(findings, config.dry_run)
    index = f"{folder}/planned"
    if config.dry_run:
        before = last_written(spark, f"{index}/index/runs", "run") + 1
        fresh = not_found(planned, planned_paths(spark, index, before).select("resource_path"), ["resource_path"])
    else:
        fresh = write_unseen(planned, index)
    return StreamAudit(
        run=run,
        clients=clients,
        findings=findings,
        counts=findings_by_client(clients, findings),
        plan=number_batches(fresh, [*CLIENT_KEY, "phase"], "target_id", config.batch_size, config.slice_digits),
        pending=pending_records(policies, clients),
    )
