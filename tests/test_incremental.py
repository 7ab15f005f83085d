"""Counts carried from run to run: whatever the order of arrival, they come to the batch verdict."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from confwarden import schemas
from confwarden.operators.liveness import dead_permissions, dead_policies
from confwarden.plans.audit import permission_edges, role_edges
from confwarden.sinks.folders import is_written, last_written
from confwarden.sinks.replay import all_planned, planned_paths, write_unseen
from confwarden.streaming import page_stream
from confwarden.streaming import incremental as inc
from conftest import rows
from test_streaming import forget_last_commit, page, policy

CLIENT = "realm string, client_uuid string, client_id string"
POLICY = ("client_uuid", "policy_id", "refs")


def clients(spark, *names):
    return spark.createDataFrame([("r", n, "x") for n in names], CLIENT)


def roles(frame, *numbers):
    return frame("role", [("r", f"role{n}", None) for n in numbers])


def bare(number, kind="role"):
    return {**policy(number, kind=kind), "config": None}


def detail(number, *ids):
    listed = [{"id": i} for i in ids]
    return {"realm": "r", "client_uuid": f"c{number % 2}", "policy_id": f"p{number}", "config": None, "roles": listed}


def association(number, *ids):
    key = {"realm": "r", "client_uuid": f"c{number % 2}", "permission_id": f"p{number}"}
    return [{**key, "policy_id": i} for i in ids]


def table(spark, entity, documents):
    schema = schemas.EXPORTS[entity]
    return spark.createDataFrame([tuple(d[n] for n in schema.fieldNames()) for d in documents], schema)


def take_policies(spark, state, known, folder, details=False):
    more = page_stream(spark, "policy_detail", f"{folder}/detail", 1) if details else None
    return inc.advance_policies(state, known, page_stream(spark, "policy", f"{folder}/page", 1), more)


def test_any_order_of_pages_details_and_roles(spark, frame, folder):
    """Pages, details and role changes dealt over runs at random; the last verdict is the batch's."""
    rng = random.Random(1)
    documents, details = [], []
    for n in range(30):
        ids = [f"role{rng.randrange(12)}" for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.4:
            documents.append(bare(n))
            details += [detail(n, *ids)] * rng.choice([0, 1, 1, 2])
        else:
            documents.append(policy(n, *ids))
            details += [detail(n, "role1")] * rng.choice([0, 0, 1])  # has a list of its own
        if rng.random() < 0.2:
            documents.append(rng.choice([documents[-1], bare(n), policy(n, "role3")]))
    runs = 3
    dealt = [[[] for _ in range(runs)] for _ in range(2)]
    for lots, items in zip(dealt, (documents, details), strict=True):
        for item in items:
            lots[rng.randrange(runs)].append(item)
    os.makedirs(f"{folder}/page")
    os.makedirs(f"{folder}/detail")
    state = inc.policy_state(spark, folder)
    for run in range(runs):
        page(f"{folder}/page", run, dealt[0][run])
        page(f"{folder}/detail", run, dealt[1][run])
        known = roles(frame, *rng.sample(range(12), 5))
        assert take_policies(spark, state, known, folder, details=True) == run
        both = clients(spark, "c0", "c1")
        arrived = [sum(lots[: run + 1], []) for lots in dealt]
        edges = role_edges(table(spark, "policy", arrived[0]), both, table(spark, "policy_detail", arrived[1]))
        want = rows(dead_policies(edges, known), "client_uuid", "policy_id")
        assert rows(inc.dead_policies_of(state, both), "client_uuid", "policy_id") == want
    only = clients(spark, "c1")
    assert rows(inc.dead_policies_of(state, only), "policy_id") == [(p,) for c, p in want if c == "c1"]
    waiting = {d["policy_id"] for d in documents} - {d["policy_id"] for d in details}
    waiting -= {d["policy_id"] for d in documents if d["config"] is not None}
    assert rows(inc.pending_records(state, None), "policy_id") == sorted((p,) for p in waiting)


def test_a_client_that_appears_later_loses_nothing(spark, frame, folder):
    page(f"{folder}/page", 0, [policy(n, "gone") for n in range(4)])
    state = inc.policy_state(spark, folder)
    take_policies(spark, state, roles(frame), folder)
    assert rows(inc.dead_policies_of(state, clients(spark, "c0")), *POLICY) == [("c0", "p0", 1), ("c0", "p2", 1)]
    take_policies(spark, state, roles(frame), folder)
    assert inc.dead_policies_of(state, clients(spark, "c0", "c1")).count() == 4


def test_permissions_follow_their_policies(spark, frame, folder):
    """Policies die, revive and arrive late; permissions and their associations come when they come."""
    both = clients(spark, "c0", "c1")
    first, second = inc.policy_state(spark, folder), inc.permission_state(spark, folder)
    os.makedirs(f"{folder}/association")

    def run(known):
        take_policies(spark, first, known, folder)
        inc.advance_permissions(
            second,
            inc.dead_policies_of(first, None),
            page_stream(spark, "policy", f"{folder}/page", 1),
            page_stream(spark, "permission_assoc", f"{folder}/association", 1),
        )
        return rows(inc.dead_permissions_of(second, both), "permission_id", "type", "refs")

    page(f"{folder}/page", 0, [policy(6, "p2", "p4", kind="scope"), bare(8, "resource"), policy(2, "role1")])
    assert run(roles(frame)) == []
    page(f"{folder}/page", 1, [policy(4, "role2")])
    assert run(roles(frame)) == [("p6", "scope", 2)]
    page(f"{folder}/association", 0, association(8, "p2", "", None))
    page(f"{folder}/association", 1, association(6, "p9"))  # has a list of its own
    assert run(roles(frame, 2)) == [("p8", "resource", 1)]
    assert run(roles(frame, 1)) == []
    last = roles(frame)
    documents = [policy(6, "p2", "p4", kind="scope"), bare(8, "resource"), policy(2, "role1"), policy(4, "role2")]
    whole = table(spark, "policy", documents)
    dead = dead_policies(role_edges(whole, both), last)
    edges = permission_edges(whole, both, table(spark, "permission_assoc", association(8, "p2", "") + association(6, "p9")))
    assert run(last) == rows(dead_permissions(edges, dead, "type"), "permission_id", "type", "refs") != []


def test_replays_and_broken_runs(spark, frame, folder, monkeypatch):
    """A batch that is replayed, in its run or the next, and a run broken off at any write count once."""
    state, both = inc.policy_state(spark, folder), clients(spark, "c0", "c1")
    for n in range(3):
        page(f"{folder}/page", n, [policy(10 * n + i, "role1", "gone") for i in range(4)])
    take_policies(spark, state, roles(frame), folder)
    first = rows(inc.dead_policies_of(state, both), *POLICY)
    assert len(first) == 12
    forget_last_commit(f"{state.folder}/checkpoints/policy")
    take_policies(spark, state, roles(frame), folder)
    assert rows(inc.dead_policies_of(state, both), *POLICY) == first
    assert rows(inc.counts_of(state).agg(F.sum("total").alias("n")), "n") == [(24,)]

    whole, page_no = inc.replace, 3
    for broken in range(1, 7):
        page(f"{folder}/page", page_no, [policy(100 + page_no, "role2")])
        left = [broken]

        def failing(*args, left=left):
            left[0] -= 1
            if not left[0]:
                raise RuntimeError("lost")
            whole(*args)

        monkeypatch.setattr(inc, "replace", failing)
        with pytest.raises(Exception, match="lost"):
            take_policies(spark, state, roles(frame, broken % 3), folder)
        monkeypatch.setattr(inc, "replace", whole)
        known = roles(frame, *range(broken % 2, 3))
        take_policies(spark, state, known, folder)
        page_no += 1
        documents = [policy(10 * n + i, "role1", "gone") for n in range(3) for i in range(4)]
        documents += [policy(100 + n, "role2") for n in range(3, page_no)]
        want = dead_policies(role_edges(table(spark, "policy", documents), both), known)
        assert rows(inc.dead_policies_of(state, both), *POLICY) == rows(want, *POLICY), broken


def files_read(df):
    """How many files the scan of a table reads after pruning."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in scans if m.contains("numFiles"))


def size(df):
    return sum(os.path.getsize(f.removeprefix("file:")) for f in df.inputFiles())


def test_a_run_reads_its_own_pages(spark, frame, folder):
    """What a verdict reads does not grow with the versions landed; a changed role reads its bucket."""
    state, both = inc.policy_state(spark, folder), clients(spark, "c0", "c1")
    read = []
    for n in range(5):
        page(f"{folder}/page", n, [policy(i, "gone", *(f"role{k}" for k in range(n))) for i in range(300)])
        take_policies(spark, state, roles(frame), folder)
        read.append(size(inc.dead_policies_of(state, both)))
    landed = spark.read.parquet(f"{state.folder}/edges")
    assert landed.count() == 300 * (1 + 2 + 3 + 4 + 5) and max(read) < 1.1 * read[0]
    assert not is_written(spark, f"{state.folder}/deltas/run=*/label=set")  # no role has changed
    known = roles(frame, 2)
    take_policies(spark, state, known, folder)
    (bucket,) = [r.bucket for r in known.select("realm", "role_id").select(inc._bucket(state).alias("bucket")).collect()]
    touched = inc.earlier_edges(state, 5, [bucket])
    assert 0 < files_read(touched) <= 5 < files_read(inc.earlier_edges(state, 5, list(range(inc.BUCKETS))))
    assert inc.dead_policies_of(state, both).isEmpty()


def test_written_folders(spark, folder):
    assert last_written(spark, f"{folder}/none", "run") == -1 and not is_written(spark, f"{folder}/none")
    for n in (2, 10):
        spark.range(1).write.parquet(f"{folder}/t/run={n}")
    os.makedirs(f"{folder}/t/run=11")
    assert last_written(spark, f"{folder}/t", "run") == 10
    assert is_written(spark, f"{folder}/t/*") and not is_written(spark, f"{folder}/t/run=11")


def test_plans_are_written_once(spark, folder):
    """Overlapping plans over many runs, one of them broken off before its index was whole."""
    schema = "realm string, resource_path string, n int"
    wanted = set()
    for run in range(7):
        paths = [f"/{i}" for i in range(run * 3, run * 3 + 6)] * 2
        plan = spark.createDataFrame([("r", p, run) for p in paths], schema)
        new = write_unseen(plan, f"{folder}/out", every=3)
        assert {r.resource_path for r in new.collect()} == set(paths) - wanted
        if run == 4:
            shutil.rmtree(f"{folder}/out/index/runs/run=4")
            write_unseen(plan, f"{folder}/out", every=3)
        wanted |= set(paths)
    written = all_planned(spark, f"{folder}/out", plan.schema)
    assert sorted(r.resource_path for r in written.collect()) == sorted(wanted)
    index = planned_paths(spark, f"{folder}/out", 7)
    assert sorted(r.resource_path for r in index.collect()) == sorted(wanted)
    assert last_written(spark, f"{folder}/out/index/compact", "upto") >= 5
    assert files_read(planned_paths(spark, f"{folder}/out", 7, [3])) < files_read(index)
    assert all_planned(spark, f"{folder}/nothing", plan.schema).isEmpty()


def test_the_set_is_looked_up_once_a_run(spark, frame, folder, monkeypatch):
    """However many batches a run has, its references are looked up at once, and come to the same counts."""
    state, both, looked_up = inc.policy_state(spark, folder), clients(spark, "c0", "c1"), counting(monkeypatch)
    known = roles(frame, 1)
    for n in range(6):
        page(f"{folder}/page", n, [policy(10 * n + i, f"role{i}", "gone", "gone") for i in range(3)] + [bare(10 * n + 3)])
    take_policies(spark, state, known, folder)
    assert len(looked_up) == 1
    counted = rows(inc.counts_of(state), "policy_id", "refs", "total", "hits", "pending")
    want = [[f"p{10 * n + i}", 3, 3, int(i == 1), False] for n in range(6) for i in range(3)]
    assert counted == sorted(map(tuple, want + [[f"p{10 * n + 3}", 0, 0, 0, True] for n in range(6)]), key=repr)
    page(f"{folder}/page", 6, [policy(1, "role1")])
    take_policies(spark, state, roles(frame, 2), folder)
    assert len(looked_up) == 3  # its own pages, and the earlier references to changed roles
    dead = [(f"p{10 * n + i}",) for n in range(6) for i in (0, 1)]
    assert rows(inc.dead_policies_of(state, both), "policy_id") == sorted(dead)


def test_members_without_a_name_change_nothing(spark, frame, folder):
    """A null in both sets is no change, and one that joins finds no reference."""
    state, both = inc.policy_state(spark, folder), clients(spark, "c0", "c1")
    page(f"{folder}/page", 0, [policy(2, "role1", "role1"), policy(4, "gone")])
    for known, want in ((("role1", None), [("p4",)]), ((None, "gone", "gone"), [("p2",)]), ((None, None), [("p2",), ("p4",)])):
        take_policies(spark, state, frame("role", [("r", name, None) for name in known]), folder)
        assert rows(inc.dead_policies_of(state, both), "policy_id") == want


def counting(monkeypatch):
    """How often references are looked up from now on."""
    looked_up, lookup = [], inc.lookup
    monkeypatch.setattr(inc, "lookup", lambda *args: looked_up.append(1) or lookup(*args))
    return looked_up


def test_associations_are_looked_up_once_a_run(spark, frame, folder, monkeypatch):
    """Batches of permissions and of associations make one lookup among the dead policies."""
    state, both, looked_up = inc.permission_state(spark, folder), clients(spark, "c0", "c1"), counting(monkeypatch)
    dead = table(spark, "policy", [policy(2), policy(4)])
    for n in range(4):
        page(f"{folder}/page", n, [bare(10 + n, "scope"), policy(20 + n, "p2", kind="scope")])
        page(f"{folder}/association", n, association(10 + n, "p2", "p4", *["p6"] * (n == 2)))
    pages = page_stream(spark, "policy", f"{folder}/page", 1)
    inc.advance_permissions(state, dead, pages, page_stream(spark, "permission_assoc", f"{folder}/association", 1))
    assert len(looked_up) == 1
    # Dead policies are of c0, so p11, p13, p21 and p23 of c1 have none; p12 has one that lives.
    assert rows(inc.dead_permissions_of(state, both), "permission_id", "refs") == [("p10", 2), ("p20", 1), ("p22", 1)]


def test_details_are_looked_up_once_a_run(spark, frame, folder, monkeypatch):
    """Batches of policies and of their details make one lookup among the roles, and count alike."""
    state, both, looked_up = inc.policy_state(spark, folder), clients(spark, "c0", "c1"), counting(monkeypatch)
    os.makedirs(f"{folder}/detail")
    for n in range(4):
        page(f"{folder}/page", n, [bare(10 * n + i) for i in range(3)])
    take_policies(spark, state, roles(frame, 1), folder, details=False)
    assert len(looked_up) == 1
    names = sorted((f"p{10 * n + i}",) for n in range(4) for i in range(3))
    assert rows(inc.pending_records(state, None), "policy_id") == names
    for n in range(4):
        page(f"{folder}/detail", n, [detail(10 * n, "gone", "gone"), detail(10 * n + 1, "gone", "role1")])
    take_policies(spark, state, roles(frame, 1), folder, details=True)
    assert len(looked_up) == 2
    assert rows(inc.dead_policies_of(state, both), "policy_id", "refs") == [(f"p{10 * n}", 2) for n in range(4)]
    assert rows(inc.pending_records(state, None), "policy_id") == sorted((f"p{10 * n + 2}",) for n in range(4))


def test_an_empty_set_is_not_looked_up(spark, frame, folder, monkeypatch):
    """References that land before there is any dead policy are not dealt out to find none."""
    state, both, looked_up = inc.permission_state(spark, folder), clients(spark, "c0", "c1"), counting(monkeypatch)
    for n in range(3):
        page(f"{folder}/page", n, [bare(10 + n, "scope"), policy(20 + n, "p2", kind="scope")])
        page(f"{folder}/association", n, association(10 + n, "p2", *["p6"] * (n == 2)))

    def run(dead):
        pages = page_stream(spark, "policy", f"{folder}/page", 1)
        inc.advance_permissions(state, dead, pages, page_stream(spark, "permission_assoc", f"{folder}/association", 1))
        return rows(inc.dead_permissions_of(state, both), "permission_id", "refs")

    dead = table(spark, "policy", [policy(2)])
    assert run(dead.limit(0)) == [] and not looked_up
    assert rows(inc.counts_of(state), "permission_id", "total", "hits")[0] == ("p10", 1, 0)
    assert run(dead) == [("p10", 1), ("p20", 1), ("p22", 1)]
    assert len(looked_up) == 1  # what has landed earlier, among the changes


def test_found_references_lie_record_by_record(spark, frame, folder):
    """The lookup deals them out by role; in their files they are sorted by record again."""
    state = inc.policy_state(spark, folder)
    page(f"{folder}/page", 0, [policy(n % 50, *[f"role{n % 7}", f"role{n % 11}", "gone"]) for n in range(300)])
    take_policies(spark, state, roles(frame, *range(11)), folder)
    edges = spark.read.parquet(f"{state.folder}/edges").select("*", F.input_file_name().alias("file")).collect()
    assert len(edges) == 900 and len({e.file for e in edges}) > 1
    for file in {e.file for e in edges}:
        mine = [(e.policy_id, e.client_uuid) for e in edges if e.file == file]
        assert mine == sorted(mine)


def test_without_details_nothing_is_joined(spark, frame, folder):
    """What waits for a detail is read from the counts alone as long as no detail has come."""
    state = inc.policy_state(spark, folder)
    page(f"{folder}/page", 0, [policy(1, "gone"), bare(2), bare(4)])
    take_policies(spark, state, roles(frame, 1), folder)
    waiting = inc.pending_records(state, None)
    assert rows(waiting, "policy_id") == [("p2",), ("p4",)]
    plan = waiting._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    page(f"{folder}/detail", 0, [detail(2, "gone")])
    take_policies(spark, state, roles(frame, 1), folder, details=True)
    assert rows(inc.pending_records(state, None), "policy_id") == [("p4",)]


def test_clients_and_members_are_never_broadcast(spark, frame, folder, monkeypatch):
    """However small their files: the lookup of a run and the scope of a verdict come from shuffles."""
    state, plans, replace = inc.policy_state(spark, folder), [], inc.replace

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(inc, "replace", lambda df, *args: planned(df) or replace(df, *args))
    page(f"{folder}/page", 0, [policy(2, "gone"), policy(3, "role1"), bare(4)])
    page(f"{folder}/detail", 0, [detail(4, "gone")])
    clients(spark, "c0").write.parquet(f"{folder}/client")
    take_policies(spark, state, roles(frame, 1), folder, details=True)
    dead = inc.in_scope(inc.counts_of(state).filter("hits = 0"), spark.read.parquet(f"{folder}/client"))
    planned(dead.select("policy_id"))
    assert "LeftOuter" in "".join(plans[:-1]) and not any("BroadcastExchange" in plan for plan in plans[:-1])
    assert "SortMergeJoin" in plans[-1] and "LeftSemi" in plans[-1].split("SortMergeJoin")[1]
    assert rows(dead, "policy_id") == [("p2",), ("p4",)]
