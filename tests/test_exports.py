import json
import os

import pytest

from confwarden.__main__ import main
from confwarden.sources import land_export, read_pages, read_table
from conftest import rows
from test_audit import permission, role_policy


def test_pages_as_lines_and_as_files(spark, folder):
    documents = [{"realm": "r", "role_id": f"id{n}", "extra": [1]} for n in range(5)]
    os.makedirs(f"{folder}/lines")
    with open(f"{folder}/lines/a.json", "w") as out:
        out.write(json.dumps(documents[:2]) + "\n" + json.dumps(documents[2]) + "\n" + json.dumps(documents[3:]))
    os.makedirs(f"{folder}/files")
    with open(f"{folder}/files/a.json", "w") as out:
        out.write(json.dumps(documents, indent=2))
    expected = [("r", f"id{n}", None) for n in range(5)]
    columns = ("realm", "role_id", "owner_client")
    assert rows(read_pages(spark, "role", f"{folder}/lines"), *columns) == expected
    assert rows(read_pages(spark, "role", f"{folder}/files", array_files=True), *columns) == expected


def test_bad_page_fails_the_read(spark, folder):
    with open(f"{folder}/a.json", "w") as out:
        out.write('[{"realm": "r", "role_id": "x"}]\nWARN 503\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_pages(spark, "role", folder).collect()


def test_document_without_its_key_fails_the_read(spark, folder):
    with open(f"{folder}/a.json", "w") as out:
        out.write('[{"realm": "r", "id": "x", "clientId": "y"}]\n')
    with pytest.raises(Exception, match="a document of client lacks client_uuid"):
        read_pages(spark, "client", folder).collect()


def test_filters_and_columns_reach_the_reader(spark, frame, folder):
    policies = frame("policy", [role_policy("r", "c", "p", "x"), permission("r", "c", "q", "p")])
    landed = land_export(policies, f"{folder}/by-type", by="type")
    plan = explain(landed.filter("type = 'role'").select("policy_id"))
    assert "PartitionFilters: [isnotnull(type" in plan and "ReadSchema: struct<policy_id:string>" in plan
    land_export(policies, f"{folder}/plain")
    table = read_table(spark, "policy", f"{folder}/plain")
    plan = explain(table.filter("type = 'role'").select("policy_id"))
    assert "PushedFilters: [IsNotNull(type), EqualTo(type,role)]" in plan
    assert "ReadSchema: struct<policy_id:string,type:string>" in plan
    assert rows(table.filter("type = 'role'"), "policy_id") == [("p",)]


def explain(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_command_line(spark, frame, folder):
    export, out = f"{folder}/export", f"{folder}/out"
    tables = {
        "realm": [("master",), ("r",)],
        "client": [("r", "c", "r-login-application", True, None, None), ("master", "m", "old", True, None, None)],
        "role": [("r", "alive", None)],
        "policy": [role_policy("r", "c", "p", "gone"), permission("r", "c", "x", "p")],
    }
    for name, values in tables.items():
        frame(name, values).write.json(f"{export}/{name}")
    main(["audit", "--export", export, "--out", out, "--run-id", "1"])
    plan = spark.read.parquet(f"{out}/run-1/plan")
    assert rows(plan, "target_id", "apply") == [("p", False), ("x", False)]
    main(["audit", "--export", export, "--out", out, "--run-id", "2", "--apply"])
    # The dry run has not marked anything as done; the run that applies has.
    assert rows(spark.read.parquet(f"{out}/run-2/plan"), "target_id", "apply") == [("p", True), ("x", True)]
    assert spark.read.parquet(f"{out}/run-2/findings").filter("msg IS NOT NULL").count() == 2
    main(["audit", "--export", export, "--out", out, "--run-id", "3", "--apply"])
    assert spark.read.parquet(f"{out}/run-3/dead_policy").count() == 0
    main(["audit", "--export", export, "--out", out, "--run-id", "5", "--apply", "--reset"])
    assert spark.read.parquet(f"{out}/run-5/dead_policy").count() == 1
    with pytest.raises(ValueError, match="no tenants named absent"):
        main(["audit", "--export", export, "--out", out, "--tenants", "r,absent"])
    main(["token-mode", "--export", export, "--out", f"{out}/mode", "--mode", "lightweight"])
    main(["token-mode", "--export", export, "--out", f"{out}/mode", "--mode", "lightweight"])
    assert rows(spark.read.parquet(f"{out}/mode/clients"), "client_uuid") == [("c",)]
    assert spark.read.parquet(f"{out}/mode/missing").count() == 3
    main(["ensure-clients", "--export", export, "--out", f"{out}/ensure", "--clients", "old,new"])
    plan = spark.read.parquet(f"{out}/ensure/clients")
    assert rows(plan, "client_id", "action") == [("new", "create"), ("old", "patch")]


def test_flat_exports_give_no_bodies(spark, frame, folder):
    export, out = f"{folder}/export", f"{folder}/out"
    frame("realm", [("r",)]).write.json(f"{export}/realm")
    frame("client", [("r", "c", "r-login-application", True, None, None)]).write.json(f"{export}/client")
    frame("policy", [role_policy("r", "c", "p", "gone")]).write.json(f"{export}/policy")
    main(["token-mode", "--export", export, "--out", out, "--mode", "lightweight"])
    for name in ("clients", "policies"):
        assert "body" not in spark.read.parquet(f"{out}/{name}").columns


def test_stream_job(spark, frame, folder):
    """Called again as pages arrive; an applied run plans what no earlier one has planned."""
    export, out = f"{folder}/export", f"{folder}/out"
    frame("realm", [("r",)]).write.json(f"{export}/realm")
    frame("client", [("r", "c", "r-login-application", True, None, None)]).write.json(f"{export}/client")
    frame("role", [("r", "alive", None)]).write.json(f"{export}/role")

    def arrive(*documents):
        frame("policy", list(documents)).coalesce(1).write.mode("append").json(f"{export}/policy")

    def run(number, *more):
        main(["stream", "--export", export, "--out", out, *more])
        plan = spark.read.schema("target_id string, apply boolean").parquet(f"{out}/results/run={number}/plan")
        return rows(plan, "target_id", "apply")

    arrive(role_policy("r", "c", "p", "gone"), permission("r", "c", "x", "p", "q"))
    assert run(0) == [("p", False)] == run(1)
    assert run(2, "--apply") == [("p", True)]
    arrive(role_policy("r", "c", "q", "lost"))
    assert run(3) == [("q", False), ("x", False)]
    assert run(4, "--apply") == [("q", True), ("x", True)] and run(5, "--apply") == []
    frame("role", [("r", "lost", None)]).write.mode("append").json(f"{export}/role")
    assert run(6, "--apply") == []
    found = spark.read.parquet(f"{out}/results/run=6/log")
    assert rows(found, "target_id") == [("p",)] and found.filter("msg IS NULL").isEmpty()
    frame("policy_detail", [("r", "c", "z", None, [("gone",)])]).write.json(f"{export}/policy_detail")
    arrive(("r", "c", "z", "n", "role", None), ("r", "c", "w", "n", "role", None))
    assert run(7, "--apply") == [("z", True)]
    assert rows(spark.read.parquet(f"{out}/results/run=7/pending"), "policy_id") == [("w",)]
