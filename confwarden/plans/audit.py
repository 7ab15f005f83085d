"""Audit: role policies whose roles are all gone, permissions left with such policies only.

The plan is made from one snapshot, so nothing shifts while it is read, and equals what a
dry run reports.  Scope and both sets of findings are landed: phase two, the delete plan
and the counters read them from there instead of computing them again, and a lost executor
costs no more than its own tasks.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.functions import log_line, policy_path
from confwarden.operators.batches import SLICE_DIGITS, number_batches
from confwarden.operators.clients import (
    CLIENT_KEY,
    clients_in_scope,
    drop_reserved,
    only_targets,
    pending,
)
from confwarden.operators.counts import findings_by_client, run_summary
from confwarden.operators.liveness import dead_permissions, dead_policies
from confwarden.operators.lookup import lookup, only_found
from confwarden.operators.refs import (
    POLICY_KEY,
    complete_assoc_refs,
    complete_role_refs,
    explode_refs,
    policies_of_type,
    with_assoc_ids,
    with_role_ids,
)
from confwarden.session import land, work_folder
from confwarden.sinks.ledger import done_rows, record_run
from confwarden.sinks.replay import write_unseen
from confwarden.sinks.tables import write_plan
from confwarden.sources.guard import complete_realms, rejected_exports
from confwarden.sources.snapshots import SNAPSHOT, mixtures
from confwarden.sources.targets import target_list, unknown_targets
from confwarden.sources.tenant_pages import broken_tenants


@dataclass(frozen=True)
class AuditConfig:
    """Parameters of a run; an empty ``tenants`` text means all tenants.

    ``slice_digits``: batches are numbered in 16 to that power slices for each client and phase
    (see ``number_batches``); a client with very many findings wants more.
    """

    pattern: str = fixed.CLIENT_PATTERN
    tenants: str = ""
    reserved: str = fixed.RESERVED_REALM
    batch_size: int = fixed.BATCH_SIZE
    dry_run: bool = True
    slice_digits: int = SLICE_DIGITS


@dataclass(frozen=True)
class Entities:
    """One snapshot.  ``roles`` holds realm roles and client roles of all tenants.

    ``details`` and ``associations`` complete records whose lists are empty; ``manifest``
    announces row counts per tenant; ``ledger`` says what earlier runs have done;
    ``outcomes`` what became of the paths of an applied plan; ``broken`` the lines of pages that
    could not be read (``sources.tenant_pages``), whose tenants are left out.
    """

    realms: DataFrame
    clients: DataFrame
    roles: DataFrame
    policies: DataFrame
    details: DataFrame | None = None
    associations: DataFrame | None = None
    manifest: DataFrame | None = None
    ledger: DataFrame | None = None
    outcomes: DataFrame | None = None
    broken: DataFrame | None = None


@dataclass(frozen=True)
class AuditResult:
    realms: DataFrame
    clients: DataFrame
    dead_policies: DataFrame
    dead_permissions: DataFrame
    findings: DataFrame
    counts: DataFrame
    plan: DataFrame
    summary: DataFrame
    folder: str
    config: AuditConfig
    rejected: DataFrame | None = None


def land_counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``land``, and how many rows were written, counted by the tasks that write them.

    These are the last tasks of the job, so a task that is repeated is counted once.
    """
    written = Observation()
    return land(df.observe(written, F.count(F.lit(1)).alias("n")), path), written.get["n"]


def scope_of(entities: Entities, config: AuditConfig, folder: str):
    """Tenants and clients this run looks at."""
    targets = target_list(config.tenants)
    realms = drop_reserved(only_targets(entities.realms, targets), config.reserved)
    clients = clients_in_scope(entities.clients, config.pattern, targets, config.reserved)
    rejected = None
    unknown = unknown_targets(entities.realms, targets)
    if unknown:
        raise ValueError(f"the export has no tenants named {', '.join(unknown)}")
    if entities.manifest is not None:
        delivered = {
            "client": entities.clients,
            "role": entities.roles,
            "policy": entities.policies,
            "policy_detail": entities.details,
            "permission_assoc": entities.associations,
        }
        delivered = {name: df for name, df in delivered.items() if df is not None}
        rejected = land(rejected_exports(realms, entities.manifest, delivered), f"{folder}/rejected")
        realms = land(complete_realms(realms, rejected), f"{folder}/realm")
    stamps = [df for df in (entities.clients, entities.roles, entities.policies) if SNAPSHOT in df.columns]
    if stamps:  # a tenant whose rows are of more than one snapshot is not judged
        mixed = mixtures(entities).select(
            "realm",
            "entity",
            F.lit(None).cast("long").alias("expected"),
            F.col("snapshots").alias("actual"),
            F.lit("mixed snapshots").alias("reason"),
        )
        mixed = only_found(mixed, realms.select("realm"), ["realm"])
        rejected = land(mixed if rejected is None else rejected.unionByName(mixed), f"{folder}/left-out")
        realms = land(complete_realms(realms, rejected), f"{folder}/whole-realm")
    if entities.broken is not None:
        lines = only_found(broken_tenants(entities.broken), realms.select("realm"), ["realm"])
        rejected = land(lines if rejected is None else rejected.unionByName(lines), f"{folder}/unreadable")
        realms = land(complete_realms(realms, rejected), f"{folder}/readable-realm")
    clients = only_found(clients, realms.select("realm"), ["realm"])
    if entities.ledger is not None:
        done = entities.ledger.filter(F.col("status") == "done")
        # A tenant was done for the clients of one pattern; another pattern has others.
        same = F.col("phase").isNull() | (F.col("phase") == config.pattern)
        whole = done.filter(F.col("client_uuid").isNull() & same)
        realms = pending(realms, whole, ["realm"])
        clients = pending(clients, whole, ["realm"])
        clients = pending(clients, done.filter(F.col("client_uuid").isNotNull()), CLIENT_KEY)
    return realms, clients.select(*CLIENT_KEY, "client_id"), rejected


def role_edges(policies: DataFrame, clients: DataFrame, details: DataFrame | None = None):
    """References of the role policies of ``clients``."""
    mine = policies_of_type(policies, fixed.ROLE_POLICY).select(*POLICY_KEY, "config")
    mine = only_found(mine, clients.select(*CLIENT_KEY), CLIENT_KEY)
    return listed_role_edges(with_role_ids(mine).drop("config"), details)


def listed_role_edges(listed: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """The same of policies whose lists are decoded (``role_ids``)."""
    if details is not None:
        return complete_role_refs(listed, details)
    return explode_refs(listed, "role_ids", "role_id")


def permission_edges(policies: DataFrame, clients: DataFrame, associations: DataFrame | None = None):
    """Associated policies of the scope and resource permissions of ``clients``."""
    mine = policies_of_type(policies, *fixed.PERMISSION_TYPES).select(
        *CLIENT_KEY, F.col("policy_id").alias("permission_id"), "type", "config"
    )
    mine = only_found(mine, clients.select(*CLIENT_KEY), CLIENT_KEY)
    return listed_permission_edges(with_assoc_ids(mine).drop("config"), associations)


def listed_permission_edges(listed: DataFrame, associations: DataFrame | None = None) -> DataFrame:
    """The same of permissions whose lists are decoded (``policy_ids``)."""
    if associations is not None:
        return complete_assoc_refs(listed, associations)
    return explode_refs(listed, "policy_ids", "policy_id")


def all_findings(policies: DataFrame, permissions: DataFrame) -> DataFrame:
    """Both kinds of findings in one table, told apart by ``phase``."""
    columns = [*CLIENT_KEY, "phase", "type", "target_id", "refs"]
    phase = F.when(F.col("type") == "scope", fixed.PERMISSION_PHASES["scope"]).otherwise(
        fixed.PERMISSION_PHASES["resource"]
    )
    first = policies.withColumnRenamed("policy_id", "target_id").withColumns(
        {"phase": F.lit(fixed.POLICY_PHASE), "type": F.lit(fixed.ROLE_POLICY)}
    )
    second = permissions.withColumnRenamed("permission_id", "target_id").withColumn("phase", phase)
    return first.select(*columns).unionByName(second.select(*columns))


def with_names(findings: DataFrame, policies: DataFrame, clients: DataFrame) -> DataFrame:
    """Findings with ``name`` and ``client_id``, which the search does not carry along."""
    key = [*CLIENT_KEY, "target_id"]
    named = policies.select(*CLIENT_KEY, F.col("policy_id").alias("target_id"), "name")
    # Only names of findings are kept, and of two versions the first.
    names = only_found(named, findings.select(*key), key).groupBy(*key).agg(F.min("name").alias("name"))
    return lookup(findings.join(names, key, "left"), clients.select(*CLIENT_KEY, "client_id"), CLIENT_KEY)


def delete_plan(findings: DataFrame, dry_run: bool = True) -> DataFrame:
    """Findings as plan rows; in a dry run they are the same rows, marked not to apply."""
    return findings.select(
        *CLIENT_KEY,
        "phase",
        "target_id",
        F.lit("delete").alias("action"),
        policy_path(F.col("realm"), F.col("client_uuid"), F.col("target_id")).alias(
            "resource_path"
        ),
        F.lit(not dry_run).alias("apply"),
    )


def finding_log(findings: DataFrame, ts) -> DataFrame:
    """Findings with names get their log line; ``ts`` is when they were found."""
    policy = F.format_string(
        fixed.POLICY_MESSAGE,
        "realm",
        "client_id",
        "name",
        F.col("target_id").cast("string"),
        F.col("refs").cast("string"),
    )
    permission = F.format_string(
        fixed.PERMISSION_MESSAGE,
        "realm",
        "client_id",
        "type",
        "name",
        F.col("target_id").cast("string"),
    )
    message = F.when(F.col("phase") == fixed.POLICY_PHASE, policy).otherwise(permission)
    return findings.withColumn("msg", log_line(ts, "INFO", message))


def audit(entities: Entities, config: AuditConfig = AuditConfig(), folder: str | None = None) -> AuditResult:
    """Run both phases.  ``folder`` is a shared folder for the findings, new for each run."""
    spark = entities.realms.sparkSession
    if entities.realms.isEmpty():
        raise ValueError("the export lists no tenants")
    folder = folder or work_folder(spark, "audit")

    realms, clients, rejected = scope_of(entities, config, folder)
    clients, checked = land_counted(clients, f"{folder}/client")
    dead, policies_found = land_counted(
        dead_policies(role_edges(entities.policies, clients, entities.details), entities.roles),
        f"{folder}/dead_policy",
    )
    orphaned, permissions_found = land_counted(
        dead_permissions(
            permission_edges(entities.policies, clients, entities.associations),
            dead,
            "type",
            prune=True,
        ),
        f"{folder}/dead_permission",
    )
    findings = all_findings(dead, orphaned)
    planned = delete_plan(findings, config.dry_run)
    outcomes = entities.outcomes
    if outcomes is not None:  # those of other tenants and runs are not this run's
        outcomes = only_found(outcomes, planned.select("resource_path"), ["resource_path"])
    named = with_names(findings, entities.policies, clients)
    group = [*CLIENT_KEY, "phase"]
    # What was counted as it was written is not read again.
    known = {"clients_checked": checked, "dead_policies": policies_found, "dead_permissions": permissions_found}
    summary = run_summary(realms, outcomes=outcomes).withColumns({k: F.lit(n).cast("long") for k, n in known.items()})
    return AuditResult(
        realms=realms,
        clients=clients,
        dead_policies=dead,
        dead_permissions=orphaned,
        findings=named,
        counts=findings_by_client(clients, findings),
        plan=number_batches(planned, group, "target_id", config.batch_size, config.slice_digits),
        summary=summary,
        folder=folder,
        config=config,
        rejected=rejected,
    )


def commit_audit(result: AuditResult, ledger: str, run_id: str, ts, planned: str | None = None) -> DataFrame:
    """Write the delete plan into the run's folder, then mark the scope as done.

    With ``planned``, the folder of an index of planned paths (``sinks.replay``), an applied
    run writes only the rows that no earlier one has planned, and adds them to the index.

    In this order: a run that fails in between leaves no ledger rows, and its clients are
    audited again.  A dry run marks nothing, so the run that applies its plan finds the same
    scope.  A tenant is done for the run's pattern only.  Returns the whole ledger.
    """
    plan = result.plan
    if planned is not None and not result.config.dry_run:
        plan = write_unseen(plan, planned)
    write_plan(plan, f"{result.folder}/plan", mode="overwrite")
    rows = done_rows(result.clients, run_id, ts).unionByName(
        done_rows(result.realms, run_id, ts, phase=result.config.pattern)
    )
    return record_run(rows.limit(0) if result.config.dry_run else rows, ledger)
