import json

import pytest
from pyspark.sql import functions as F

from confwarden import fixed, schemas
from confwarden.operators.children import grant_missing
from confwarden.operators.clients import expand_targets, first_of_name, lookup_client, named_by_template, needs_patch
from confwarden.plans import ensure_clients, plan_token_mode
from confwarden.sources.exports import read_documents
from conftest import rows

MODE = fixed.TOKEN_MODE_ATTRIBUTE
CLAIM = fixed.CLAIM_KEY


def mapper(name, config=None):
    return (name, "openid-connect", "m", False, config)


def planned(clients_frame, frame, mode="lightweight", policies=(), realms=("r",), **more):
    return plan_token_mode(
        frame("realm", [(r,) for r in realms]),
        clients_frame,
        frame("policy", policies),
        templates=("-login", "sidecar"),
        mode=mode,
        **more,
    )


def bodies(plan):
    return {r.client_uuid: json.loads(r.body) for r in plan.clients.collect()}


def mappers_of(body):
    return {m["name"]: m.get("config", {}).get(CLAIM) for m in body["protocolMappers"]}


def again(spark, plan, before):
    """The client table after the plan has been applied."""
    body = (
        "struct<id:string,clientId:string,authorizationServicesEnabled:boolean,attributes:map<string,string>,"
        "protocolMappers:array<struct<name:string,protocol:string,protocolMapper:string,"
        "consentRequired:boolean,config:map<string,string>>>>"
    )
    done = plan.clients.select("realm", F.from_json("body", body).alias("b")).select(
        "realm",
        F.col("b.id").alias("client_uuid"),
        F.col("b.clientId").alias("client_id"),
        F.col("b.authorizationServicesEnabled").alias("authz_enabled"),
        F.col("b.attributes").alias("attributes"),
        F.col("b.protocolMappers").cast(schemas.CLIENT["protocol_mappers"].dataType).alias("protocol_mappers"),
    )
    rest = before.join(done.select("realm", "client_uuid"), ["realm", "client_uuid"], "left_anti")
    return rest.select(*done.columns).unionByName(done)


@pytest.fixture
def clients(frame):
    return frame(
        "client",
        [
            ("r", "u1", "r-login", True, None, None),
            ("r", "u2", "sidecar", False, {MODE: "false", "x": "1"}, [mapper("username"), mapper("other")]),
            ("r", "u3", "sidecar", True, None, None),
            ("r", "u4", "r-login-2", True, None, None),
            ("s", "u5", "r-login", True, None, None),
            ("master", "u6", "sidecar", True, None, None),
        ],
    )


def test_lightweight(clients, frame):
    plan = planned(clients, frame, realms=("r", "s", "master"))
    body = bodies(plan)
    assert sorted(body) == ["u1", "u2"]
    assert body["u1"]["attributes"] == {MODE: "true"}
    assert mappers_of(body["u1"]) == {"sub": "true"}
    assert body["u2"]["attributes"] == {"x": "1", MODE: "true"}
    assert mappers_of(body["u2"]) == {"username": "true", "other": None, "sub": "true"}
    assert rows(plan.clients, "client_uuid", "no_mappers", "insert_sub", "changed", "status") == [
        ("u1", True, True, True, "process"),
        ("u2", False, True, True, "skipped"),
    ]
    assert rows(plan.missing, "realm", "client_id") == [("s", "s-login"), ("s", "sidecar")]


def test_sub_mapper_is_complete(clients, frame):
    sub = [m for m in bodies(planned(clients, frame))["u1"]["protocolMappers"] if m["name"] == "sub"]
    assert sub == [
        {
            "name": "sub",
            "protocol": "openid-connect",
            "protocolMapper": "oidc-sub-mapper",
            "consentRequired": False,
            "config": {"lightweight.claim": "true", "introspection.token.claim": "true", "access.token.claim": "true"},
        }
    ]


@pytest.mark.parametrize("name", fixed.PATCHED_MAPPERS)
def test_three_mappers_are_patched(frame, name):
    one = frame("client", [("r", "u", "sidecar", True, None, [mapper(name, {CLAIM: "false", "k": "v"})])])
    assert mappers_of(bodies(planned(one, frame))["u"])[name] == "true"


def test_regular_is_not_the_inverse(spark, clients, frame):
    light = again(spark, planned(clients, frame), clients)
    body = bodies(planned(light, frame, mode="regular"))["u2"]
    assert body["attributes"] == {"x": "1", MODE: "false"}
    assert mappers_of(body) == {"username": "true", "other": None, "sub": "true"}


@pytest.mark.parametrize("mode", ["lightweight", "regular"])
def test_applied_twice_changes_nothing(spark, clients, frame, mode):
    applied = again(spark, planned(clients, frame, mode=mode), clients)
    second = planned(applied, frame, mode=mode)
    assert second.clients.count() == 0
    assert planned(applied, frame, mode=mode, unchanged=True).clients.count() == 2


def test_unknown_mode(clients, frame):
    with pytest.raises(KeyError):
        planned(clients, frame, mode="heavy")


def test_policies_only_of_clients_with_the_flag(clients, frame):
    policies = [
        ("r", "u1", "p1", "n", "role", None),
        ("r", "u1", "p2", "n", "role", {"fetchRoles": "true", "a": "b"}),
        ("r", "u1", "p3", "n", "scope", None),
        ("r", "u2", "p4", "n", "role", None),
        ("r", "u4", "p5", "n", "role", None),
    ]
    plan = planned(clients, frame, policies=policies, unchanged=True)
    assert rows(plan.policies, "target_id", "changed") == [("p1", True), ("p2", False)]
    body = {r.target_id: json.loads(r.body) for r in plan.policies.collect()}
    assert body["p2"]["config"] == {"a": "b", "fetchRoles": "true"}
    assert plan.without_policies.count() == 0
    regular = planned(clients, frame, mode="regular", policies=policies)
    assert rows(regular.policies, "target_id") == [("p1",), ("p2",)]
    assert rows(planned(clients, frame).without_policies, "client_uuid") == [("u1",)]


def test_lookups_agree(frame, clients):
    targets = expand_targets(frame("realm", [("r",), ("s",)]), ("-login", "sidecar"))
    by_join = rows(lookup_client(targets, clients), "realm", "client_id", "client_uuid")
    by_filter = rows(
        first_of_name(named_by_template(clients, ("-login", "sidecar"))).filter("realm <> 'master'"),
        "realm",
        "client_id",
        "client_uuid",
    )
    assert by_join == by_filter == [("r", "r-login", "u1"), ("r", "sidecar", "u2")]


def test_needs_patch(frame):
    clients = frame(
        "client",
        [
            ("r", "none", "c", True, None),
            ("r", "absent", "c", True, {"x": "true"}),
            ("r", "off", "c", True, {MODE: "false"}),
            ("r", "on", "c", True, {MODE: "true"}),
        ],
    )
    assert rows(needs_patch(clients), "client_uuid") == [("absent",), ("none",), ("off",)]


def test_ensure_clients(frame):
    realm_roles = mapper("realm roles", {CLAIM: "true"})
    existing = frame(
        "client",
        [
            ("master", "u1", "abc-2", True, None, None),
            ("master", "u2", "half", True, {MODE: "true"}, [mapper("realm roles for all")]),
            ("master", "u3", "ready", True, {MODE: "true", "k": "v"}, [realm_roles]),
            ("master", "u4", "unwanted", True, None, None),
        ],
    )
    desired = frame("client", [("master", None, n) for n in ("abc", "half", "ready")])
    plan = ensure_clients(desired, existing)
    columns = ("client_id", "action", "set_attribute", "add_mapper", "grants", "username")
    assert rows(plan, *columns) == [
        ("abc", "create", True, True, ["admin", "create-realm"], "service-account-abc"),
        ("abc-2", "noop", False, False, [], None),
        ("half", "patch", False, True, [], None),
        ("ready", "noop", False, False, [], None),
        ("unwanted", "noop", False, False, [], None),
    ]
    body = {r.client_id: json.loads(r.body) for r in plan.collect() if r.body}
    assert body["abc"]["serviceAccountsEnabled"] is True and body["abc"]["publicClient"] is False
    assert body["abc"]["attributes"] == {MODE: "true"}
    assert [m["name"] for m in body["half"]["protocolMappers"]] == ["realm roles for all", "realm roles"]
    assert body["half"]["id"] == "u2"


def test_grants_held_are_not_repeated(spark):
    holders = spark.createDataFrame([("a",), ("b",)], "username string")
    held = spark.createDataFrame([("a", "admin"), ("a", "admin"), ("b", "other")], "username string, role string")
    assert rows(grant_missing(holders, held, ["username"], fixed.GRANTED_ROLES), "username", "role") == [
        ("a", "create-realm"),
        ("b", "admin"),
        ("b", "create-realm"),
    ]


def test_whole_documents_survive(spark, folder):
    """Fields outside the schemas, numbers, nulls and nesting come back in the bodies."""
    client = {
        "id": "u1", "clientId": "r-login", "enabled": True, "redirectUris": ["a", "b"], "authorizationServicesEnabled": True,
        "attributes": {"n": 5, "x": None}, "nodeReRegistrationTimeout": -1, "authorizationSettings": {"policies": [{"a": 1.5}]},
        "protocolMappers": [
            {"id": "m1", "name": "username", "protocol": "p", "protocolMapper": "m", "config": {"k": "v"}, "extra": [1]},
            {"id": "m2", "name": "other", "protocol": "p", "protocolMapper": "m", "config": {"multi": True}},
        ],
    }
    policy = {"id": "p1", "name": "n", "type": "role", "logic": "NEGATIVE", "decisionStrategy": "UNANIMOUS", "config": {"roles": "[]"}, "z": None}
    for name, line in (
        ("client", {"realm": "r", "document": client}),
        ("policy", {"realm": "r", "client_uuid": "u1", "document": policy}),
    ):
        with open(f"{folder}/{name}.json", "w") as out:
            out.write(json.dumps(line) + "\n")
    clients, policies = (read_documents(spark, name, f"{folder}/{name}.json") for name in ("client", "policy"))
    plan = plan_token_mode(spark.createDataFrame([("r",)], "realm string"), clients, policies, templates=("-login",))
    body = json.loads(plan.clients.first().body)
    sub = body["protocolMappers"].pop()
    assert (sub["name"], sub["protocolMapper"]) == ("sub", fixed.SUB_MAPPER["protocol_mapper"])
    client["attributes"][MODE] = "true"
    client["protocolMappers"][0]["config"][CLAIM] = "true"
    assert body == client
    policy["config"]["fetchRoles"] = "true"
    assert json.loads(plan.policies.first().body) == policy
    assert plan.clients.first().changed and plan.without_policies.isEmpty()


def test_documents_that_cannot_be_edited_are_rejected(spark, folder):
    """A key twice in one object: the row has its keys, no body of its few known fields, and a reason."""
    good = {"id": "u1", "clientId": "r-login-application", "authorizationServicesEnabled": True, "extra": [1]}
    twice = '{"id": "u2", "clientId": "r-login-application", "authorizationServicesEnabled": true, "a": 1, "a": 2}'
    policy = {"id": "p1", "name": "n", "type": "role", "config": {}, "logic": "POSITIVE"}
    lines = {
        "client": [f'{{"realm": "r", "document": {json.dumps(good)}}}', f'{{"realm": "s", "document": {twice.replace("r-", "s-")}}}'],
        "policy": [
            f'{{"realm": "r", "client_uuid": "u1", "document": {json.dumps(policy)}}}',
            '{"realm": "r", "client_uuid": "u1", "document": {"id": "p2", "type": "role", "x": {"y": 1, "y": 2}}}',
        ],
    }
    for name, text in lines.items():
        with open(f"{folder}/{name}.json", "w") as out:
            out.write("\n".join(text) + "\n")
    clients, policies = (read_documents(spark, name, f"{folder}/{name}.json") for name in ("client", "policy"))
    realms = spark.createDataFrame([("r",), ("s",)], "realm string")
    plan = plan_token_mode(realms, clients, policies)
    assert rows(plan.clients, "client_uuid") == [("u1",)] and rows(plan.policies, "target_id") == [("p1",)]
    assert json.loads(plan.clients.first().body)["extra"] == [1]
    assert rows(plan.rejected, "realm", "client_uuid", "entity", "reason") == [
        ("r", "u1", "policy", "document cannot be edited"),
        ("s", "u2", "client", "document cannot be edited"),
    ]
