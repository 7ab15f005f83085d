"""The shape of the plans, and results under a key that holds a third of all rows."""

import contextlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from confwarden.operators.batches import number_batches
from confwarden.operators.clients import lookup_client
from confwarden.operators.liveness import dead_permissions, dead_policies, ref_counts, ref_liveness
from confwarden.operators.lookup import lookup, only_found
from confwarden.operators.roles import role_catalogue
from confwarden.operators.sticky import sticky_flag
from conftest import rows

SF = "/root/testdata/sf0.001"
ROWS = 30000


@contextlib.contextmanager
def settings(spark, **conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def large_tables(spark):
    """Make tables of some ten thousand rows behave like tables too large to broadcast."""
    return settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16",
        },
    )


def final_plan(df):
    """The plan after the query has run, without the one it started from."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def edges(spark):
    """A third of the references is to one role, spread over many policies."""
    made = spark.range(0, ROWS, numPartitions=8).select(
        F.lit("r").alias("realm"),
        F.lit("c").alias("client_uuid"),
        (F.col("id") % 9000).alias("policy_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("role_id"),
    )
    return made


def known_roles(spark):
    made = spark.range(0, 5000, numPartitions=4).select(F.lit("r").alias("realm"), F.col("id").alias("role_id"))
    return made.filter((F.col("role_id") % 4 == 1)), made.filter((F.col("role_id") % 6 == 1))


def is_known(role):
    return role % 4 == 1 or role % 6 == 1


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith("stream")))
def test_no_products_and_no_python(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "InMemoryTableScan"):
        assert bad not in plan


def test_hot_role_is_split(spark):
    realm_roles, client_roles = known_roles(spark)
    found = defaultdict(list)
    for r in edges(spark).collect():
        found[r.policy_id].append(r.role_id)
    dead = sorted((p, len(ids)) for p, ids in found.items() if not any(map(is_known, ids)))
    with large_tables(spark):
        df = dead_policies(edges(spark), realm_roles.unionByName(client_roles))
        assert "Join(skew=true)" in final_plan(df)
        assert sorted((r.policy_id, r.refs) for r in df.collect()) == dead
        catalogue = role_catalogue(realm_roles, client_roles)
        df = ref_liveness(edges(spark), catalogue)
        assert "Join(skew=true)" in final_plan(df)
        assert df.count() == ROWS
        assert df.filter("alive").count() == sum(is_known(i) for ids in found.values() for i in ids)
        df = ref_counts(edges(spark), catalogue)
        assert "Join(skew=true)" in final_plan(df)
        counted = {r.policy_id: (r.total, r.alive) for r in df.collect()}
        assert counted == {p: (len(ids), sum(map(is_known, ids))) for p, ids in found.items()}


def test_hot_policy_is_split(spark):
    """A third of all permissions rests on one policy, and dead policies come from a grouping."""
    realm_roles, client_roles = known_roles(spark)
    assoc = spark.range(0, ROWS, numPartitions=8).select(
        F.lit("r").alias("realm"),
        F.lit("c").alias("client_uuid"),
        (F.col("id") % 12000).alias("permission_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9000).alias("policy_id"),
    )
    with large_tables(spark):
        dead = dead_policies(edges(spark), realm_roles.unionByName(client_roles))
        df = dead_permissions(assoc, dead)
        assert "Join(skew=true)" in final_plan(df)
        gone = {r.policy_id for r in dead.collect()}
        found = defaultdict(list)
        for r in assoc.collect():
            found[r.permission_id].append(r.policy_id)
        expected = sorted((p, len(ids)) for p, ids in found.items() if gone.issuperset(ids))
        assert sorted((r.permission_id, r.refs) for r in df.collect()) == expected
        pruned = dead_permissions(assoc, dead, prune=True)
        assert sorted((r.permission_id, r.refs) for r in pruned.collect()) == expected


def test_hot_client_is_split(spark):
    """A third of all policies is one client's, and the clients looked for are a grouping."""
    policies = spark.range(0, ROWS, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3000).alias("client_uuid"), "id"
    )
    clients = policies.filter("client_uuid % 2 = 0").select("client_uuid").distinct()
    with large_tables(spark):
        df = only_found(policies, clients, ["client_uuid"])
        assert "Join(skew=true)" in final_plan(df)
        expected = [r.id for r in policies.collect() if r.client_uuid % 2 == 0]
        assert sorted(r.id for r in df.collect()) == sorted(expected)


def test_hot_session_is_split(spark):
    requests = spark.range(0, ROWS, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("session"),
        "id",
        (F.hash("id") % 97 == 0).alias("asked"),
    )
    with large_tables(spark):
        df = sticky_flag(requests, "session", ["id"], F.col("asked"))
        assert "Join(skew=true)" in final_plan(df)
        seen, expected = set(), {}
        for r in sorted(requests.collect(), key=lambda r: r.id):
            if r.asked:
                seen.add(r.session)
            expected[r.id] = r.session in seen
        assert {r.id: r.flag for r in df.collect()} == expected


def test_hot_name_is_split(spark):
    clients = spark.range(0, ROWS, numPartitions=8).select(
        F.lit("r").alias("realm"),
        F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") % 5000).cast("string")).alias("client_id"),
        F.col("id").alias("client_uuid"),
    )
    targets = clients.select("realm", "client_id").distinct()
    with large_tables(spark):
        df = lookup_client(targets, clients)
        assert "Join(skew=true)" in final_plan(df)
        found = {}
        for r in clients.collect():
            found[r.client_id] = min(r.client_uuid, found.get(r.client_id, r.client_uuid))
        assert {r.client_id: r.client_uuid for r in df.collect()} == found


def test_hot_client_is_numbered_in_slices(spark):
    findings = spark.range(0, 20000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("client"),
        F.concat(F.lit("policy-"), "id").alias("target"),
    )
    df = number_batches(findings, ["client"], "target", 50)
    sizes = defaultdict(Counter)
    for r in df.collect():
        sizes[r.client][r.batch_no] += 1
    totals = Counter(r.client for r in findings.collect())
    for client, batches in sizes.items():
        assert sorted(batches) == list(range(len(batches)))
        full = [batches[n] for n in range(len(batches) - 1)]
        assert set(full) <= {50} and sum(batches.values()) == totals[client]
    windows = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [row" in line]
    assert windows and all("slice" in line for line in windows)


def test_types_must_agree(spark):
    left = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(TypeError):
        lookup(left, spark.createDataFrame([(1,)], "k long"), ["k"])


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    """Both verdicts against loops over small random graphs with several tenants and clients."""
    pick = random.Random(seed)
    tenants, owners = ["r", "s"], ["c", "d"]
    refs = [
        (pick.choice(tenants), pick.choice(owners), f"p{pick.randrange(9)}", f"role{pick.randrange(8)}")
        for _ in range(50)
    ]
    roles = {(pick.choice(tenants), f"role{pick.randrange(8)}") for _ in range(5)}
    assoc = [
        (pick.choice(tenants), pick.choice(owners), f"x{pick.randrange(9)}", f"p{pick.randrange(9)}")
        for _ in range(40)
    ]
    by_policy, by_permission = defaultdict(list), defaultdict(list)
    for realm, client, p, role in refs:
        by_policy[realm, client, p].append((realm, role))
    dead = {k for k, found in by_policy.items() if not roles.intersection(found)}
    for realm, client, x, p in assoc:
        by_permission[realm, client, x].append((realm, client, p))
    orphaned = {k for k, found in by_permission.items() if dead.issuperset(found)}

    key = "realm string, client_uuid string"
    known = spark.createDataFrame(sorted(roles) * 2, "realm string, role_id string")
    found = dead_policies(spark.createDataFrame(refs, f"{key}, policy_id string, role_id string"), known)
    lost = dead_permissions(
        spark.createDataFrame(assoc, f"{key}, permission_id string, policy_id string"), found
    )
    assert set(rows(found, "realm", "client_uuid", "policy_id")) == dead
    assert set(rows(lost, "realm", "client_uuid", "permission_id")) == orphaned
