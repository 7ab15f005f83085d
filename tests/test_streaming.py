"""Streams: over any split of the same pages they find what the batch finds."""

import importlib
import json
import os

import pytest
from pyspark.sql import functions as F

from confwarden import schemas
from confwarden.operators.liveness import dead_permissions, dead_policies
from confwarden.operators.sticky import sticky_flag
from confwarden.plans.audit import permission_edges, role_edges
from confwarden.sinks import cursors, unseen
from confwarden.streaming import (
    page_stream,
    phases,
    read_batches,
    stream_dead_permissions,
    stream_dead_policies,
    stream_plan,
    stream_sticky_flag,
)
from conftest import rows


def page(folder, number, documents):
    """One exported page: a JSON array on one line."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/page-{number}.json", "w") as out:
        out.write(json.dumps(documents) + "\n")


def forget_last_commit(checkpoint):
    """As if the query had stopped after its last batch wrote, before that was recorded."""
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    os.remove(f"{checkpoint}/commits/{last}")
    os.remove(f"{checkpoint}/commits/.{last}.crc")


def policy(number, *ids, kind="role"):
    key = "roles" if kind == "role" else "applyPolicies"
    listed = [{"id": i} for i in ids]
    return {
        "realm": "r",
        "client_uuid": f"c{number % 2}",
        "policy_id": f"p{number}",
        "name": "n",
        "type": kind,
        "config": {key: json.dumps(listed)},
    }


@pytest.fixture
def known(spark, frame):
    clients = spark.createDataFrame(
        [("r", "c0", "x"), ("r", "c1", "y")], "realm string, client_uuid string, client_id string"
    )
    return clients, frame("role", [("r", f"role{n}", None) for n in range(0, 40, 3)])


def test_policy_pages_in_several_runs(spark, known, folder):
    clients, roles = known
    pages = f"{folder}/pages"
    documents = [policy(n, f"role{n}", f"role{n + 1}") for n in range(20)]
    page(pages, 0, documents[:7])
    page(pages, 1, documents[7:9])

    def run():
        stream = page_stream(spark, "policy", pages, files_per_batch=1)
        return stream_dead_policies(stream, clients, roles, folder, "run-1")

    columns = ("client_uuid", "policy_id", "refs")
    first = rows(run(), *columns)
    page(pages, 2, documents[9:])
    page(pages, 3, documents[:5])
    second = rows(run(), *columns)
    whole = spark.createDataFrame([tuple(d.values()) for d in documents], schemas.POLICY)
    batch = rows(dead_policies(role_edges(whole, clients), roles), *columns)
    assert second == batch and set(first) < set(second)
    assert rows(run(), *columns) == second

    ledger = read_batches(spark, f"{folder}/ledger/dead_policy", schemas.RUN_LEDGER)
    assert rows(cursors(ledger), "client_uuid", "cursor") == [
        ("c0", "phase=1;offset=13"),
        ("c1", "phase=1;offset=12"),
    ]


def test_replayed_batch_repeats_nothing(spark, known, folder):
    clients, roles = known

    def run():
        stream = page_stream(spark, "policy", f"{folder}/pages", files_per_batch=1)
        found = stream_dead_policies(stream, clients, roles, folder, "run-1")
        ledger = read_batches(spark, f"{folder}/ledger/dead_policy", schemas.RUN_LEDGER)
        return found.count(), spark.read.parquet(f"{folder}/dead_policy").count(), rows(cursors(ledger), "cursor")

    for number in range(3):
        page(f"{folder}/pages", number, [policy(10 * number + n, "gone") for n in range(4)])
    first = run()
    assert first == (12, 12, [("phase=1;offset=6",), ("phase=1;offset=6",)])
    forget_last_commit(f"{folder}/checkpoints/dead_policy")
    assert run() == first


def test_permissions_after_policies(spark, known, folder):
    clients, roles = known
    documents = [policy(n, f"role{n}") for n in range(12)]
    permissions = []
    for n in range(12):
        found = policy(n, f"p{n}", f"p{(n + 2) % 12}", kind="scope" if n < 6 else "resource")
        permissions.append({**found, "policy_id": f"x{n}"})
    for number in range(3):
        page(f"{folder}/pages", number, documents[number::3] + permissions[number::3])
    dead = stream_dead_policies(
        page_stream(spark, "policy", f"{folder}/pages", 1), clients, roles, folder, "run-1"
    )
    found = stream_dead_permissions(
        page_stream(spark, "policy", f"{folder}/pages", 1), clients, dead, folder, "run-1"
    )
    whole = spark.createDataFrame([tuple(d.values()) for d in documents + permissions], schemas.POLICY)
    batch_dead = dead_policies(role_edges(whole, clients), roles)
    batch = dead_permissions(permission_edges(whole, clients), batch_dead, "type")
    columns = ("client_uuid", "permission_id", "type", "refs")
    assert rows(found, *columns) == rows(batch, *columns) != []


def test_unreadable_page_fails_and_leaves_no_trace(spark, known, folder):
    clients, roles = known
    page(f"{folder}/pages", 0, [policy(1, "gone")])
    with open(f"{folder}/pages/page-1.json", "w") as out:
        out.write("WARN retrying\n")
    with pytest.raises(Exception, match="(?i)malformed|foreachBatch"):
        stream_dead_policies(
            page_stream(spark, "policy", f"{folder}/pages"), clients, roles, folder, "run-1"
        )
    assert not os.path.exists(f"{folder}/ledger/dead_policy/batch_id=0/_SUCCESS")


def test_plan_written_twice(spark):
    plan = spark.createDataFrame([("/a", 1), ("/b", 1), ("/b", 1)], "resource_path string, n int")
    written = spark.createDataFrame([("/a",)], "resource_path string")
    assert rows(unseen(plan, written), "resource_path") == [("/b",)]
    assert unseen(plan, plan).count() == 0


REQUESTS = "session string, at long, flag_in boolean"


def request_files(spark, folder, *parts):
    for part in parts:
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(folder)


def test_sticky_flag_in_order_of_arrival(spark, folder):
    source = f"{folder}/requests"
    schema = spark.createDataFrame([], REQUESTS).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return stream_sticky_flag(stream, "session", ["at"], F.col("flag_in"), f"{folder}/sticky")

    first = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False)]
    request_files(spark, source, first)
    assert rows(run(), "session", "at", "flag") == [
        ("a", 1, False),
        ("a", 2, True),
        ("a", 3, True),
        ("b", 1, False),
    ]
    request_files(spark, source, [("a", 4, False), ("b", 2, None), ("b", 3, True), ("b", 4, False)])
    run()
    request_files(spark, source, [("b", 5, False), ("c", 1, False), ("a", 5, True)])
    streamed = run()
    stored = spark.read.parquet(source)
    batch = sticky_flag(stored, "session", ["at"], F.col("flag_in"))
    assert rows(streamed, "session", "at", "flag") == rows(batch, "session", "at", "flag")
    assert rows(run(), "session", "at", "flag") == rows(streamed, "session", "at", "flag")
    forget_last_commit(f"{folder}/sticky/checkpoint")
    assert rows(run(), "session", "at", "flag") == rows(batch, "session", "at", "flag")


def test_a_later_version_revives_a_policy(spark, known, folder):
    clients, roles = known
    for number, ids in enumerate((["gone"], ["gone", "role3"])):
        page(f"{folder}/policy", number, [policy(2, *ids)])
    stream = page_stream(spark, "policy", f"{folder}/policy", files_per_batch=1)
    assert stream_dead_policies(stream, clients, roles, folder, "run-1").isEmpty()


def test_policies_may_arrive_after_their_permissions(spark, known, folder):
    clients, roles = known

    def run(run_id):
        pages = page_stream(spark, "policy", f"{folder}/policy")
        dead = stream_dead_policies(pages, clients, roles, folder, run_id)
        return rows(stream_dead_permissions(pages, clients, dead, folder, run_id), "permission_id")

    page(f"{folder}/policy", 0, [policy(2, "gone"), policy(6, "p2", "p4", kind="scope")])
    assert run("run-1") == []
    page(f"{folder}/policy", 1, [policy(4, "gone too")])
    assert run("run-2") == [("p6",)]


def test_cursors_count_the_scope_only(spark, known, folder):
    clients, roles = known
    page(f"{folder}/policy", 0, [policy(2, "gone"), {**policy(3, "gone"), "client_uuid": "unknown"}])
    stream_dead_policies(page_stream(spark, "policy", f"{folder}/policy"), clients, roles, folder, "run-1")
    ledger = read_batches(spark, f"{folder}/ledger/dead_policy", schemas.RUN_LEDGER)
    assert rows(cursors(ledger), "client_uuid", "offset") == [("c0", 1)]


def written(folder):
    return sorted(name for name in os.listdir(folder) if name.startswith("batch_id="))


def test_scope_is_joined_once_a_run(spark, known, folder):
    """However many batches a run has, one join with the clients, one ledger table and one of edges."""
    clients, roles = known
    for run, last in enumerate((4, 7)):
        for number in range(5 * run, last + 1):
            page(f"{folder}/pages", number, [policy(10 * number + n, "gone", "gone too") for n in range(4)])
        stream = page_stream(spark, "policy", f"{folder}/pages", files_per_batch=1)
        found = stream_dead_policies(stream, clients, roles, folder, "run-1")
        assert found.count() == 4 * (last + 1)
    assert written(f"{folder}/dead_policy") == written(f"{folder}/ledger/dead_policy") == ["batch_id=4", "batch_id=7"]
    assert spark.read.parquet(f"{folder}/dead_policy").count() == 2 * 4 * 8


@pytest.mark.parametrize("lost", ["replace", "write_batch"])
def test_a_run_that_breaks_off_is_settled_by_the_next(spark, known, folder, monkeypatch, lost):
    """Broken off before its second batch or before its ledger: every page counts once."""
    clients, roles = known
    for number in range(3):
        page(f"{folder}/pages", number, [policy(10 * number + n, "gone") for n in range(4)])

    def run():
        stream = page_stream(spark, "policy", f"{folder}/pages", files_per_batch=1)
        return stream_dead_policies(stream, clients, roles, folder, "run-1")

    whole, left = getattr(phases, lost), [2 if lost == "replace" else 1]

    def failing(*args):
        left[0] -= 1
        if not left[0]:
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(phases, lost, failing)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(phases, lost, whole)
    page(f"{folder}/pages", 3, [policy(30 + n, "gone") for n in range(4)])
    for _ in range(2):
        assert run().count() == 16 and spark.read.parquet(f"{folder}/dead_policy").count() == 16
        ledger = read_batches(spark, f"{folder}/ledger/dead_policy", schemas.RUN_LEDGER)
        assert rows(cursors(ledger), "client_uuid", "offset") == [("c0", 8), ("c1", 8)]


def test_plan_works_out_its_verdicts_once(spark, known, folder):
    """Numbering reads its rows twice: they come from a table, not from the pages' references."""
    clients, roles = known
    page(f"{folder}/pages", 0, [policy(n, "gone") for n in range(4)] + [policy(8, "p0", "p2", kind="scope")])
    stream = page_stream(spark, "policy", f"{folder}/pages")
    dead = stream_dead_policies(stream, clients, roles, folder, "run-1")
    plan = stream_plan(dead, stream_dead_permissions(stream, clients, dead, folder, "run-1"), batch_size=2)
    assert rows(plan, "client_uuid", "phase", "batch_no") == [
        ("c0", "1", 0),
        ("c0", "1", 0),
        ("c0", "2-scope", 0),
        ("c1", "1", 0),
        ("c1", "1", 0),
    ]
    assert all("/stream-findings-" in file for file in plan.inputFiles())


def test_associations_are_joined_once_a_run(spark, known, folder, monkeypatch):
    """The association table is read once for all batches, and counts as it would batch by batch."""
    clients, _ = known
    key = [("r", f"c{n % 2}", f"p{n}") for n in range(12)]
    associations = spark.createDataFrame([(*k, p) for k in key for p in ("x", "y", "")], schemas.PERMISSION_ASSOC)
    dead = spark.createDataFrame(
        [("r", "c0", "x"), ("r", "c0", "y"), ("r", "c1", "x")], "realm string, client_uuid string, policy_id string"
    )
    for number in range(6):
        mine = [{**policy(n, kind="scope"), "config": None} for n in (2 * number, 2 * number + 1)]
        page(f"{folder}/pages", number, mine)
    audit = importlib.import_module("confwarden.plans.audit")  # the package has a function of that name
    joined, complete = [], audit.complete_assoc_refs
    monkeypatch.setattr(audit, "complete_assoc_refs", lambda *args: joined.append(1) or complete(*args))
    stream = page_stream(spark, "policy", f"{folder}/pages", files_per_batch=1)
    found = stream_dead_permissions(stream, clients, dead, folder, "run-1", associations)
    assert rows(found, "client_uuid", "permission_id", "refs") == sorted(("c0", f"p{n}", 2) for n in range(0, 12, 2))
    assert len(joined) == 2  # all batches, and the empty table that gives the schema


def test_clients_and_roles_are_never_broadcast(spark, known, folder, monkeypatch):
    """However small their files: references, ledger rows and the verdict come from shuffles."""
    clients, roles = known
    clients.write.parquet(f"{folder}/client")
    roles.write.parquet(f"{folder}/role")
    clients, roles = spark.read.parquet(f"{folder}/client"), spark.read.parquet(f"{folder}/role")
    page(f"{folder}/pages", 0, [policy(n, "gone") for n in range(4)])
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    replace, write_batch = phases.replace, phases.write_batch
    monkeypatch.setattr(phases, "replace", lambda df, *args: planned(df) or replace(df, *args))
    monkeypatch.setattr(phases, "write_batch", lambda df, *args: planned(df) or write_batch(df, *args))
    dead = stream_dead_policies(page_stream(spark, "policy", f"{folder}/pages"), clients, roles, folder, "run-1")
    planned(dead)
    assert sum("Join" in plan for plan in plans) == 3 and not any("Broadcast" in plan for plan in plans)
    assert rows(dead, "policy_id") == [("p0",), ("p1",), ("p2",), ("p3",)]
