"""Jobs from the command line, over an export folder with one subfolder per entity.

spark-submit -m confwarden audit        --export DIR --out DIR [--pattern RE] [--tenants a,b]
spark-submit -m confwarden stream       --export DIR --out DIR [--apply]   (again as pages arrive)
spark-submit -m confwarden token-mode   --export DIR --out DIR --mode lightweight|regular
spark-submit -m confwarden ensure-clients --export DIR --out DIR --clients a,b
"""

import argparse
import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.operators.counts import outcomes_by_path
from confwarden.operators.lookup import lookup
from confwarden.plans import (
    AuditConfig,
    Entities,
    audit,
    commit_audit,
    ensure_clients,
    plan_token_mode,
    stream_audit,
)
from confwarden.plans.audit import finding_log
from confwarden.session import build_session
from confwarden.sinks import read_ledger, write_plan
from confwarden.sources import read_pages, read_table, target_list
from confwarden.sources.exports import read_documents
from confwarden.streaming import page_stream


def _format(spark, args):
    """The format asked for; else whole documents if the clients come as such, or flat JSON."""
    if args.format != "auto":
        return args.format
    line = spark.read.text(f"{args.export}/client").select(F.get_json_object("value", "$.document").alias("d"))
    return "documents" if line.limit(1).filter("d IS NOT NULL").count() else "json"


def _reader(spark, args):
    args.format = _format(spark, args)
    formats = {"json": read_pages, "parquet": read_table, "documents": read_pages}

    def entity(name, required=True):
        whole = args.format == "documents" and name in ("client", "policy")
        read = read_documents if whole else formats[args.format]
        try:
            return read(spark, name, f"{args.export}/{name}")
        except AnalysisException as error:
            if required or error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    return entity


def run_audit(spark, args):
    entity = _reader(spark, args)
    run_id = args.run_id or uuid.uuid4().hex
    ledger = f"{args.out}/ledger"
    attempts = entity("outcome", required=False)
    result = audit(
        Entities(
            realms=entity("realm"),
            clients=entity("client"),
            roles=entity("role"),
            policies=entity("policy"),
            details=entity("policy_detail", required=False),
            associations=entity("permission_assoc", required=False),
            manifest=entity("manifest", required=False),
            ledger=None if args.reset else read_ledger(spark, ledger),
            outcomes=outcomes_by_path(attempts) if attempts is not None else None,
        ),
        AuditConfig(args.pattern, args.tenants, args.reserved, args.batch_size, not args.apply),
        folder=f"{args.out}/run-{run_id}",
    )
    now = F.lit(datetime.datetime.now(datetime.timezone.utc))
    commit_audit(result, ledger, run_id, now, planned=None if args.reset else f"{args.out}/planned")
    findings = finding_log(result.findings, now)
    write_plan(findings, f"{result.folder}/findings", mode="overwrite")
    write_plan(result.counts, f"{result.folder}/counts", mode="overwrite")
    if result.rejected is not None:
        result.rejected.show(truncate=False)
    result.summary.show(truncate=False)


def run_stream(spark, args):
    entity = _reader(spark, args)

    def pages(name, required=True):
        try:
            return page_stream(spark, name, f"{args.export}/{name}")
        except AnalysisException as error:
            if required or error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    result = stream_audit(
        spark,
        Entities(
            realms=entity("realm"),
            clients=entity("client"),
            roles=entity("role"),
            policies=pages("policy"),
            details=pages("policy_detail", required=False),
            associations=pages("permission_assoc", required=False),
        ),
        args.out,
        AuditConfig(args.pattern, args.tenants, args.reserved, args.batch_size, not args.apply),
    )
    now = F.lit(datetime.datetime.now(datetime.timezone.utc))
    folder = f"{args.out}/results/run={result.run}"
    write_plan(result.plan, f"{folder}/plan", mode="overwrite")
    write_plan(result.counts, f"{folder}/counts", mode="overwrite")
    write_plan(result.pending, f"{folder}/pending", mode="overwrite")
    names = result.clients.select("realm", "client_uuid", "client_id")
    listed = lookup(result.findings.withColumn("name", F.lit(None).cast("string")), names, ["realm", "client_uuid"])
    write_plan(finding_log(listed, now), f"{folder}/log", mode="overwrite")


def run_token_mode(spark, args):
    entity = _reader(spark, args)
    templates = target_list(args.templates) or fixed.CLIENT_TEMPLATES
    plan = plan_token_mode(
        entity("realm"),
        entity("client"),
        entity("policy"),
        templates=templates,
        mode=args.mode,
        reserved=args.reserved,
    )
    # Plans replace those of an earlier run over the same folder: a repeated run adds nothing.
    clients, policies = plan.clients, plan.policies
    if args.format != "documents":
        # A body replaces a whole document; a flat export has some of its fields only.
        clients, policies = (p.withColumnRenamed("body", "fields") for p in (clients, policies))
    write_plan(clients, f"{args.out}/clients", mode="overwrite")
    write_plan(policies, f"{args.out}/policies", mode="overwrite")
    write_plan(plan.rejected, f"{args.out}/rejected", mode="overwrite")
    write_plan(plan.missing, f"{args.out}/missing", mode="overwrite")
    write_plan(plan.without_policies, f"{args.out}/without_policies", mode="overwrite")


def run_ensure_clients(spark, args):
    entity = _reader(spark, args)
    names = F.array(*[F.lit(n) for n in target_list(args.clients)])
    realm = entity("realm").filter(F.col("realm") == args.reserved)
    desired = realm.select("realm", F.explode(names).alias("client_id"))
    existing = entity("client").filter(F.col("realm") == args.reserved)
    plan = ensure_clients(desired, existing).filter(F.col("action") != "noop")
    write_plan(plan, f"{args.out}/clients", mode="overwrite")


def parser():
    top = argparse.ArgumentParser(prog="confwarden")
    jobs = top.add_subparsers(required=True)

    def job(name, run):
        sub = jobs.add_parser(name)
        sub.add_argument("--export", required=True, help="folder with a subfolder per entity")
        sub.add_argument("--out", required=True)
        sub.add_argument("--format", choices=("auto", "json", "parquet", "documents"), default="auto")
        sub.add_argument("--reserved", default=fixed.RESERVED_REALM)
        sub.set_defaults(run=run)
        return sub

    for name, run in (("stream", run_stream), ("audit", run_audit)):
        sub = job(name, run)
        sub.add_argument("--pattern", default=fixed.CLIENT_PATTERN)
        sub.add_argument("--tenants", default="")
        sub.add_argument("--batch-size", type=int, default=fixed.BATCH_SIZE)
        sub.add_argument("--apply", action="store_true", help="mark the plan rows as to be applied")
    sub.add_argument("--reset", action="store_true", help="audit again what the ledger calls done")
    sub.add_argument("--run-id")

    sub = job("token-mode", run_token_mode)
    sub.add_argument("--mode", choices=("lightweight", "regular"), required=True)
    sub.add_argument("--templates", default="", help="client names; a leading - is a suffix to the tenant")

    sub = job("ensure-clients", run_ensure_clients)
    sub.add_argument("--clients", required=True, help="names of the wanted clients")
    return top


def main(argv=None):
    args = parser().parse_args(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
