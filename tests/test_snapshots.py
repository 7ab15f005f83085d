"""Snapshots, the compact ledger, pages by index."""

import os

import pytest
from pyspark.sql import functions as F

from confwarden.operators.batches import page, read_page, write_pages
from confwarden.plans import AuditConfig, Entities, audit, commit_audit
from confwarden.sinks import done_rows, read_ledger, record_run
from confwarden.sources import land_export
from confwarden.sources.snapshots import entities_as_of, mixtures, newest, stamped, whole_snapshots
from confwarden.sources.tenant_pages import read_tenant_pages
from conftest import rows
from test_audit import role_policy
from test_incremental import files_read

MANIFEST = "realm string, snapshot_id int, entity string, expected long"


def exports(frame, *, late_roles=1):
    """Two snapshots of tenants r and s; in the second a role of r is gone, and s lacks pages."""
    clients = frame("client", [(t, "c", f"{t}-x-application", True, None, None) for t in "rs"])
    policies = frame("policy", [role_policy(t, "c", f"p{n}", f"role{n}") for t in "rs" for n in range(2)])
    first = frame("role", [(t, f"role{n}", None) for t in "rs" for n in range(2)])
    second = frame("role", [("r", "role0", None)] * late_roles)
    both = lambda df: stamped(df, 1).unionByName(stamped(df, 2))
    return Entities(
        realms=frame("realm", [("r",), ("s",), ("t",)]),
        clients=both(clients),
        roles=stamped(first, 1).unionByName(stamped(second, 2)),
        policies=both(policies),
    )


def manifest(spark):
    counts = {"client": (1, 1), "role": (2, 1), "policy": (2, 2)}
    listed = [(t, s + 1, e, n[s]) for t in "rs" for e, n in counts.items() for s in range(2)]
    return spark.createDataFrame(listed + [("t", 1, "client", 0)], MANIFEST)


def test_each_tenant_is_judged_by_its_newest_whole_snapshot(spark, frame):
    entities = exports(frame)
    taken, chosen = entities_as_of(entities, manifest(spark))
    assert rows(chosen, "realm", "snapshot_id") == [("r", 2), ("s", 1)]
    assert rows(audit(taken, AuditConfig(pattern="")).dead_policies, "realm", "policy_id") == [("r", "p1")]
    early, chosen = entities_as_of(entities, manifest(spark), at=1)
    assert rows(chosen, "realm", "snapshot_id") == [("r", 1), ("s", 1)]
    assert audit(early, AuditConfig(pattern="")).dead_policies.isEmpty()
    with pytest.raises(ValueError, match="no tenants"):
        audit(entities_as_of(entities, manifest(spark), at=0)[0], AuditConfig(pattern=""))


def test_what_makes_a_snapshot_whole(spark, frame):
    entities = exports(frame, late_roles=3)  # one role three times is one role
    delivered = {"client": entities.clients, "role": entities.roles, "policy": entities.policies}
    whole = whole_snapshots(manifest(spark), delivered)
    assert rows(whole, "realm", "snapshot_id") == [("r", 1), ("r", 2), ("s", 1)]
    assert rows(newest(whole), "realm", "snapshot_id") == [("r", 2), ("s", 1)]
    without = manifest(spark).filter("NOT (realm = 'r' AND snapshot_id = 2 AND entity = 'client')")
    assert rows(whole_snapshots(without, delivered), "realm", "snapshot_id") == [("r", 1), ("s", 1)]


def test_mixtures_are_rejected(spark, frame):
    """Unpicked entities hold two snapshots of every tenant; a job judges none of them."""
    entities = exports(frame)
    found = mixtures(entities)
    assert rows(found, "realm", "entity", "snapshots") == [
        (t, e, 2 if (t, e) != ("s", "roles") else 1) for t in "rs" for e in ("clients", "policies", "roles")
    ]
    result = audit(entities, AuditConfig(pattern=""))
    assert result.dead_policies.isEmpty() and result.clients.isEmpty()
    assert {r.reason for r in result.rejected.collect()} == {"mixed snapshots"}
    plain = Entities(*(getattr(entities, f).drop("snapshot_id") for f in ("realms", "clients", "roles", "policies")))
    assert mixtures(plain).isEmpty()


def test_a_ledger_of_many_runs_is_one_table_and_a_tail(spark, folder):
    clients = spark.createDataFrame([("r", f"c{n}") for n in range(6)], "realm string, client_uuid string")
    path = f"{folder}/ledger"
    for run in range(10):
        ledger = record_run(done_rows(clients, f"run-{run}", F.lit(f"2024-01-{run + 1:02} 00:00:00")), path, every=4)
        if run % 4 == 1:
            reads = done_rows(clients.limit(2), f"run-{run}", F.lit("2024-01-01")).withColumns(
                {"status": F.lit("read"), "phase": F.lit("1"), "offset": F.lit(5).cast("long")}
            )
            ledger = record_run(reads, path, every=4)
    assert ledger.count() <= 8 + 4 * 6 and files_read(ledger) < 13
    latest = ledger.filter("status = 'done'").groupBy("client_uuid").agg(F.max("run_id").alias("run_id"))
    assert rows(latest, "client_uuid", "run_id") == [(f"c{n}", "run-9") for n in range(6)]
    assert rows(ledger.filter("status = 'read'").groupBy("realm").agg(F.sum("offset").alias("n")), "n") == [(30,)]
    assert read_ledger(spark, f"{folder}/none").isEmpty()


def test_an_applied_audit_plans_nothing_twice(spark, frame, folder):
    entities = Entities(
        frame("realm", [("r",)]),
        frame("client", [("r", "c", "x", True, None, None)]),
        frame("role", []),
        frame("policy", [role_policy("r", "c", "p", "gone")]),
    )
    at = F.lit("2024-01-01 00:00:00")

    def plan(run, **how):
        result = audit(entities, AuditConfig(pattern="", **how), folder=f"{folder}/run-{run}")
        commit_audit(result, f"{folder}/ledger", f"run-{run}", at, planned=f"{folder}/planned")
        return spark.read.schema("target_id string").parquet(f"{folder}/run-{run}/plan").count()

    assert [plan(0), plan(1, dry_run=False), plan(2, dry_run=False), plan(3)] == [1, 1, 0, 1]


def test_deep_pages(spark, folder):
    """A page by index is that of the whole order, ties and edges included, and reads few files."""
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), "id").repartition(7)
    write_pages(df, ["k", "id"], folder, ranges=16)
    for offset, limit in ((0, 10), (2345, 400), (4990, 50), (5000, 5), (0, 0)):
        got = read_page(spark, folder, df.schema, ["k", "id"], offset, limit)
        want = page(df, ["k", "id"], offset, limit)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    deep = read_page(spark, folder, df.schema, ["k", "id"], 4500, 100)
    assert len(deep.collect()) == 100
    write_pages(df.limit(0), ["k", "id"], f"{folder}/none", ranges=4)
    assert read_page(spark, f"{folder}/none", df.schema, ["k", "id"], 0, 10).isEmpty()


def test_a_broken_page_keeps_its_tenant_out(spark, frame, folder):
    """One cut line, one document without its key: two tenants are named, the third is audited."""
    for tenant, lines in {
        "r": ['[{"client_uuid": "c", "policy_id": "p", "type": "role", "config": {"roles": "[{\\"id\\": \\"gone\\"}]"}}]'],
        "s": ['[{"client_uuid": "c", "policy_id": "p", "type"', '{"client_uuid": "c", "policy_id": "q", "type": "role"}'],
        "t": ['{"client_uuid": "c", "id": "p", "type": "role"}'],
    }.items():
        os.makedirs(f"{folder}/export/realm={tenant}")
        with open(f"{folder}/export/realm={tenant}/a.json", "w") as out:
            out.write("\n".join(lines) + "\n")
    policies, broken = read_tenant_pages(spark, "policy", f"{folder}/export", f"{folder}/landed")
    assert rows(policies, "realm", "policy_id") == [("r", "p"), ("s", "q")]
    assert rows(broken, "realm", "reason") == [("s", "unreadable line"), ("t", "lacks policy_id")]
    assert all("/realm=" in r.file for r in broken.collect())
    entities = Entities(
        frame("realm", [("r",), ("s",), ("t",)]),
        frame("client", [(t, "c", "x", True, None, None) for t in "rst"]),
        frame("role", []),
        policies,
        broken=broken,
    )
    result = audit(entities, AuditConfig(pattern=""))
    assert rows(result.dead_policies, "realm") == [("r",)] and rows(result.clients, "realm") == [("r",)]
    assert rows(result.rejected, "realm", "entity", "reason") == [
        ("s", "policy", "unreadable line"),
        ("t", "policy", "lacks policy_id"),
    ]
    os.makedirs(f"{folder}/flat")
    with open(f"{folder}/flat/a.json", "w") as out:
        out.write("WARN 503\n")
    with pytest.raises(Exception, match="outside the folder of a tenant"):
        read_tenant_pages(spark, "policy", f"{folder}/flat", f"{folder}/flat-landed")


def test_tenants_prune_partitions_as_the_query_runs(spark, frame, folder):
    """A landed table by tenant, joined with the tenants chosen: the scan skips the others' files."""
    policies = frame("policy", [role_policy(t, "c", f"p{n}", "gone") for t in "rstu" for n in range(3)])
    landed = land_export(policies, f"{folder}/policy", by="realm")
    spark.createDataFrame([("s", 1), ("x", 2)], "realm string, wanted int").write.parquet(f"{folder}/targets")
    targets = spark.read.parquet(f"{folder}/targets").filter("wanted = 1").select("realm")
    found = landed.join(targets, "realm", "left_semi")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert rows(found, "realm", "policy_id") == [("s", f"p{n}") for n in range(3)]


def test_counters_come_from_the_writes(spark, frame):
    """The summary reads none of the tables whose rows were counted as they were written."""
    entities = Entities(
        frame("realm", [("r",), ("s",)]),
        frame("client", [("r", f"c{n}", "x", True, None, None) for n in range(5)]),
        frame("role", []),
        frame("policy", [role_policy("r", f"c{n}", "p", "gone") for n in range(3)]),
    )
    result = audit(entities, AuditConfig(pattern="", slice_digits=1))
    assert result.summary.first()[:4] == (2, 5, 3, 0) and result.summary.inputFiles() == []
    assert rows(result.plan, "client_uuid", "batch_no") == [(f"c{n}", 0) for n in range(3)]
