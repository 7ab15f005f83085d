"""The audit on hand-written configurations."""

import json

import pytest
from pyspark.sql import functions as F

from confwarden.operators.clients import drop_reserved, matching_clients, pending, split_by_authz
from confwarden.operators.counts import findings_by_client, outcomes_by_path
from confwarden.plans import AuditConfig, Entities, audit, commit_audit
from confwarden.plans.audit import finding_log
from conftest import rows


def roles_text(*ids):
    return json.dumps([{"id": i, "required": False} for i in ids])


def role_policy(realm, client, name, *ids, text=None):
    config = {"roles": roles_text(*ids) if text is None else text}
    return (realm, client, name, f"policy {name}", "role", config)


def permission(realm, client, name, *ids, kind="scope", text=None):
    config = {"applyPolicies": json.dumps(ids) if text is None else text}
    return (realm, client, name, f"permission {name}", kind, config)


@pytest.fixture
def snapshot(frame):
    def make(policies, roles=(("r", "alive", None),), clients=None, realms=("r",), **more):
        clients = clients or [("r", "c", "x-application", True)]
        return Entities(
            realms=frame("realm", [(r,) for r in realms]),
            clients=frame("client", clients),
            roles=frame("role", roles),
            policies=frame("policy", policies),
            **more,
        )

    return make


def dead(result):
    return [r[0] for r in rows(result.dead_policies, "policy_id")]


def orphaned(result):
    return [r[0] for r in rows(result.dead_permissions, "permission_id")]


def test_records_without_references_are_never_dead(snapshot):
    texts = ["", "[]", "not json", '{"id":"x"}', '"s"', '[{"id":"gone"},"b"]']
    bare = [role_policy("r", "c", f"p{n}", text=text) for n, text in enumerate(texts)]
    absent = [("r", "c", "none", "n", "role", None), ("r", "c", "empty", "n", "role", {})]
    result = audit(snapshot([*bare, *absent, role_policy("r", "c", "q", "gone")]))
    assert dead(result) == ["q"]


def test_blank_ids_do_not_count(snapshot):
    text = '[{"id":null},{"id":""},{"id":"gone"}]'
    result = audit(snapshot([role_policy("r", "c", "p", text=text)]))
    assert rows(result.dead_policies, "policy_id", "refs") == [("p", 1)]


def test_repeated_ids_count_each_time(snapshot):
    result = audit(snapshot([role_policy("r", "c", "p", "gone", "gone")]))
    assert rows(result.dead_policies, "policy_id", "refs") == [("p", 2)]


def test_one_live_role_keeps_a_policy(snapshot):
    result = audit(snapshot([role_policy("r", "c", "p", "gone", "alive")]))
    assert dead(result) == []


def test_role_of_another_tenant_does_not_count(snapshot):
    result = audit(snapshot([role_policy("r", "c", "p", "other")], roles=[("s", "other", None)]))
    assert dead(result) == ["p"]


def test_client_roles_count(snapshot):
    result = audit(snapshot([role_policy("r", "c", "p", "mine")], roles=[("r", "mine", "some-client")]))
    assert dead(result) == []


def test_role_listed_twice_changes_nothing(snapshot):
    roles = [("r", "alive", None), ("r", "alive", "client")]
    result = audit(
        snapshot([role_policy("r", "c", "p", "gone", "alive"), role_policy("r", "c", "q", "gone")], roles)
    )
    assert rows(result.dead_policies, "policy_id", "refs") == [("q", 1)]


def test_details_complete_empty_lists(snapshot, frame):
    details = frame(
        "policy_detail",
        [
            ("r", "c", "p", None, [("gone",)]),
            ("r", "c", "q", {"roles": roles_text("alive")}, [("gone",)]),
            ("r", "c", "s", {"roles": "[]"}, [("gone",), ("alive",)]),
            ("r", "c", "t", None, [("",), (None,)]),
            ("r", "c", "v", None, [("alive",)]),
        ],
    )
    policies = [role_policy("r", "c", name, text="") for name in "pqst"]
    result = audit(snapshot([*policies, role_policy("r", "c", "v", "gone")], details=details))
    assert dead(result) == ["p", "v"]


def test_permission_needs_every_policy_dead(snapshot):
    result = audit(
        snapshot(
            [
                role_policy("r", "c", "p", "gone"),
                role_policy("r", "c", "q", "gone"),
                role_policy("r", "c", "k", "alive"),
                ("r", "c", "other", "n", "user", None),
                permission("r", "c", "all dead", "p", "q"),
                permission("r", "c", "one kept", "p", "k"),
                permission("r", "c", "another type", "p", "other"),
                permission("r", "c", "none", text="[]"),
                permission("r", "c", "objects", text='["p",{"id":"q"}]', kind="resource"),
                permission("r", "c", "unlisted type", "p", kind="js"),
            ]
        )
    )
    assert orphaned(result) == ["all dead", "objects"]


def test_permission_on_a_dead_permission_survives(snapshot):
    result = audit(
        snapshot(
            [role_policy("r", "c", "p", "gone"), permission("r", "c", "a", "p"), permission("r", "c", "b", "a")]
        )
    )
    assert orphaned(result) == ["a"]


def test_policy_ids_belong_to_their_client(snapshot):
    clients = [("r", "c", "a-application", True), ("r", "d", "b-application", True)]
    result = audit(
        snapshot(
            [
                role_policy("r", "c", "p", "gone"),
                role_policy("r", "d", "p", "alive"),
                role_policy("r", "d", "q", "gone"),
                permission("r", "c", "x", "p"),
                permission("r", "d", "x", "p"),
            ],
            clients=clients,
        )
    )
    assert rows(result.dead_permissions, "client_uuid", "permission_id") == [("c", "x")]


def test_associations_complete_empty_lists(snapshot, frame):
    associations = frame(
        "permission_assoc",
        [
            ("r", "c", "bare", "p"),
            ("r", "c", "bare", ""),
            ("r", "c", "bare kept", "p"),
            ("r", "c", "bare kept", "k"),
            ("r", "c", "listed", "k"),
        ],
    )
    result = audit(
        snapshot(
            [
                role_policy("r", "c", "p", "gone"),
                role_policy("r", "c", "k", "alive"),
                permission("r", "c", "bare", text=""),
                permission("r", "c", "bare kept", text="[]"),
                permission("r", "c", "listed", "p"),
            ],
            associations=associations,
        )
    )
    assert rows(result.dead_permissions, "permission_id", "refs") == [("bare", 1), ("listed", 1)]


def test_page_exported_twice(snapshot):
    documents = [role_policy("r", "c", "p", "gone", "lost"), permission("r", "c", "x", "p")]
    result = audit(snapshot(documents * 2))
    assert rows(result.dead_policies, "policy_id", "refs") == [("p", 2)]
    assert rows(result.dead_permissions, "permission_id", "refs") == [("x", 1)]


def test_two_versions_of_a_policy(snapshot):
    """Pages of one export may straddle an edit: what is alive in either version stays."""
    versions = [role_policy("r", "c", "p", "gone"), role_policy("r", "c", "p", "gone", "alive")]
    pages = [*versions, role_policy("r", "c", "q", "gone"), permission("r", "c", "x", "p", "q")]
    result = audit(snapshot([*pages, permission("r", "c", "y", "q"), permission("r", "c", "y", "p", "q")]))
    assert dead(result) == ["q"]
    assert orphaned(result) == []


def test_findings_are_named(snapshot):
    found = audit(snapshot([role_policy("r", "c", "p", "gone"), permission("r", "c", "x", "p")]))
    log = finding_log(found.findings, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    assert rows(log, "msg") == [
        ("2024-01-01T00:00:00Z [INFO]   [r/x-application] dead role-policy: policy p (p) refs=1",),
        ("2024-01-01T00:00:00Z [INFO]   [r/x-application] dead scope permission: permission x (x)",),
    ]


def test_scope(snapshot):
    clients = [
        ("r", "yes", "x-application", True),
        ("r", "no-flag", "x-application", False),
        ("r", "null-flag", "x-application", None),
        ("r", "no-match", "application-x", True),
        ("master", "reserved", "x-application", True),
        ("s", "elsewhere", "x-application", True),
    ]
    policies = [role_policy(c[0], c[1], f"of {c[1]}", "gone") for c in clients]
    everything = snapshot(policies, clients=clients, realms=("r", "s", "master"))
    assert dead(audit(everything)) == ["of elsewhere", "of yes"]
    assert dead(audit(everything, AuditConfig(tenants=" r,, r,master "))) == ["of yes"]
    assert dead(audit(everything, AuditConfig(pattern="^application"))) == ["of no-match"]


def test_filters(frame):
    clients = frame("client", [("r", "a", "x-1", True), ("r", "b", "y-1", False), ("master", "c", "x", None)])
    assert rows(drop_reserved(clients), "client_uuid") == [("a",), ("b",)]
    assert rows(matching_clients(clients, "-"), "client_uuid") == [("a",), ("b",)]
    assert rows(split_by_authz(clients), "client_uuid", "status") == [
        ("a", "process"),
        ("b", "skipped"),
        ("c", "skipped"),
    ]


def test_no_tenants_is_an_error(snapshot):
    with pytest.raises(ValueError):
        audit(snapshot([role_policy("r", "c", "p", "gone")], realms=()))


def test_incomplete_tenant_is_rejected(snapshot, frame):
    clients = [("r", "c", "x-application", True), ("s", "d", "x-application", True), ("t", "e", "x-application", True)]
    policies = [role_policy(r, c, f"of {r}", "gone") for r, c, *_ in clients]
    manifest = frame(
        "manifest",
        [
            *[(r, e, 1) for r in "rs" for e in ("client", "policy")],
            ("r", "role", 1),
            ("s", "role", 2),
            ("t", "policy", 1),
        ],
    )
    result = audit(
        snapshot(
            policies,
            roles=[("r", "alive", None), ("s", "alive", None)],
            clients=clients,
            realms=("r", "s", "t"),
            manifest=manifest,
        )
    )
    assert dead(result) == ["of r"]
    assert rows(result.rejected, "realm", "entity", "expected", "actual", "reason") == [
        ("s", "role", 2, 1, "incomplete"),
        ("t", "client", None, None, "not announced"),
        ("t", "role", None, None, "not announced"),
    ]
    assert result.summary.first()["realms_processed"] == 1


def test_associations_are_guarded_too(snapshot, frame):
    policies = [role_policy("r", "c", "p", "gone"), permission("r", "c", "x", text="[]")]
    links = frame("permission_assoc", [("r", "c", "x", "p")])
    announced = [("r", "client", 1), ("r", "role", 1), ("r", "policy", 2)]

    def run(*more):
        return audit(snapshot(policies, associations=links, manifest=frame("manifest", [*announced, *more])))

    assert rows(run().rejected, "entity", "reason") == [("permission_assoc", "not announced")]
    short = run(("r", "permission_assoc", 2))
    assert rows(short.rejected, "entity", "actual", "reason") == [("permission_assoc", 1, "incomplete")]
    assert short.plan.isEmpty()
    assert rows(run(("r", "permission_assoc", 1)).plan, "target_id") == [("p",), ("x",)]


def test_clients_of_unlisted_tenants_stay_out(snapshot):
    clients = [("r", "c", "x-application", True), ("other", "d", "x-application", True)]
    policies = [role_policy("r", "c", "p", "gone"), role_policy("other", "d", "q", "gone")]
    assert dead(audit(snapshot(policies, clients=clients))) == ["p"]


def test_outcomes_of_other_runs_do_not_count(snapshot, spark):
    policies = [role_policy("r", "c", "p", "gone"), role_policy("r", "c", "q", "gone")]
    path = audit(snapshot(policies)).plan.filter("target_id = 'p'").first()["resource_path"]
    attempts = [(path, 500), (path, 204), (path.replace("/r/", "/other/"), 204), ("/elsewhere", 403)]
    outcomes = outcomes_by_path(spark.createDataFrame(attempts, "resource_path string, http_code int"))
    summary = audit(snapshot(policies, outcomes=outcomes)).summary.first()
    assert (summary["deleted"], summary["delete_failures"]) == (1, 0)


def test_another_pattern_is_another_scope(snapshot, folder):
    clients = [("r", "c", "x-application", True), ("r", "d", "y-other", True)]
    policies = [role_policy("r", "c", "p", "gone"), role_policy("r", "d", "q", "gone")]
    first = audit(snapshot(policies, clients=clients), AuditConfig(dry_run=False))
    ledger = commit_audit(first, f"{folder}/ledger", "run-1", F.lit("2024-01-01 00:00:00"))
    other = audit(snapshot(policies, clients=clients, ledger=ledger), AuditConfig(pattern="-other$"))
    assert (dead(first), dead(other)) == (["p"], ["q"])


def test_a_page_twice_does_not_stand_in_for_a_missing_one(snapshot, frame):
    manifest = frame("manifest", [("r", "client", 1), ("r", "role", 2), ("r", "policy", 1)])
    policies = [role_policy("r", "c", "p", "gone")]
    twice = snapshot(policies, roles=[("r", "alive", None)] * 2, manifest=manifest)
    assert dead(audit(twice)) == []
    both = snapshot(policies * 2, roles=[("r", "alive", None), ("r", "other", None)], manifest=manifest)
    assert dead(audit(both)) == ["p"]


def test_plan_and_counts(snapshot):
    clients = [("r", "c", "x-application", True), ("r", "d", "y-application", True)]
    policies = [role_policy("r", "c", f"p{n}", "gone") for n in range(5)]
    result = audit(
        snapshot([*policies, permission("r", "c", "x", "p1", "p2", kind="resource")], clients=clients),
        AuditConfig(batch_size=2),
    )
    plan = rows(result.plan, "phase", "batch_no")
    assert plan == [("1", 0), ("1", 0), ("1", 1), ("1", 1), ("1", 2), ("2-resource", 0)]
    assert {r.apply for r in result.plan.collect()} == {False}
    assert rows(result.counts, "client_uuid", "phase", "n") == [
        ("c", "1", 5),
        ("c", "2-resource", 1),
        ("c", "2-scope", 0),
        ("d", "1", 0),
        ("d", "2-resource", 0),
        ("d", "2-scope", 0),
    ]
    assert tuple(result.summary.first()) == (1, 2, 5, 1, 0, 0)
    applied = audit(snapshot(policies, clients=clients), AuditConfig(dry_run=False))
    assert {r.apply for r in applied.plan.collect()} == {True}


def test_outcomes_of_an_applied_plan(snapshot, frame):
    attempts = frame("outcome", [("/a", 503), ("/a", 204), ("/b", 404), ("/c", 401), ("/c", 503), ("/d", 400)])
    outcomes = outcomes_by_path(attempts)
    assert rows(outcomes, "resource_path", "outcome") == [("/a", "OK"), ("/b", "OK"), ("/c", "FAIL"), ("/d", "FAIL")]
    result = audit(snapshot([role_policy("r", "c", "p", "gone")], outcomes=outcomes))
    assert tuple(result.summary.first()) == (1, 1, 1, 0, 0, 0)  # none of them is of this plan


def test_second_run_does_nothing(spark, snapshot, folder):
    policies = [role_policy("r", "c", "p", "gone"), permission("r", "c", "x", "p")]
    at = F.lit("2024-01-01 00:00:00")
    dry = audit(snapshot(policies))
    assert commit_audit(dry, f"{folder}/ledger", "run-0", at).count() == 0
    first = audit(snapshot(policies), AuditConfig(dry_run=False))
    ledger = commit_audit(first, f"{folder}/ledger", "run-1", at)
    written = spark.read.schema(first.plan.schema).parquet(f"{first.folder}/plan")
    assert rows(written, "target_id") == [("p",), ("x",)]
    second = audit(snapshot(policies, ledger=ledger))
    assert tuple(second.summary.first()) == (0, 0, 0, 0, 0, 0)
    again = audit(snapshot(policies))
    assert rows(again.plan, "resource_path") == rows(first.plan, "resource_path")


def test_a_client_done_is_skipped_alone(snapshot, frame):
    clients = [("r", "c", "x-application", True), ("r", "d", "y-application", True)]
    ledger = frame("run_ledger", [("run-0", "r", "c", None, None, "done"), ("run-0", "r", "d", "1", 5, "read")])
    policies = [role_policy("r", "c", "p", "gone"), role_policy("r", "d", "q", "gone")]
    assert dead(audit(snapshot(policies, clients=clients, ledger=ledger))) == ["q"]


def test_pending_with_repeated_ledger_rows(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    done = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(pending(left, done, ["k"]), "k") == [("b",)]


def test_another_live_role_never_adds_findings(snapshot):
    policies = [role_policy("r", "c", f"p{n}", f"role{n}", f"role{n + 1}") for n in range(6)]
    policies += [permission("r", "c", f"x{n}", f"p{n}", f"p{(n + 2) % 6}") for n in range(6)]
    known = [("r", "role3", None)]
    before = audit(snapshot(policies, roles=known))
    after = audit(snapshot(policies, roles=[*known, ("r", "role5", None)]))
    assert set(dead(after)) < set(dead(before))
    assert set(orphaned(after)) <= set(orphaned(before))


def test_counts_keep_clients_without_findings(spark):
    clients = spark.createDataFrame([("r", "c")], "realm string, client_uuid string")
    none = spark.createDataFrame([], "realm string, client_uuid string, phase string")
    assert [r.n for r in findings_by_client(clients, none).collect()] == [0, 0, 0]
