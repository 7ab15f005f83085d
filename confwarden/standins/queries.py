"""One query per operator, over the stand-in entities."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confwarden import fixed, schemas
from confwarden.functions import (
    alternative,
    blank_to,
    clean_ids,
    cursor_text,
    decode_assoc_ids,
    final_outcome,
    http_outcome,
    map_upsert,
    mapper_literal,
    parse_cursor,
    patch_mappers,
    policy_path,
    tab_separated,
    trim_space,
    utc_stamp,
)
from confwarden.functions.documents import edited_policy
from confwarden.operators import batches, children, clients, counts, liveness, refs, roles, sticky
from confwarden.operators.clients import CLIENT_KEY
from confwarden.plans.audit import AuditConfig, Entities, all_findings, audit, delete_plan, finding_log
from confwarden.plans.ensure_clients import ensure_clients
from confwarden.plans.token_mode import patch_clients, plan_token_mode
from confwarden.session import land, work_folder
from confwarden.sinks import append_ledger, cursors, done_rows, record_run, unseen, write_plan
from confwarden.sinks.replay import all_planned, write_unseen
from confwarden.sources import explode_targets, incomplete_exports, read_pages
from confwarden.sources.guard import ENTITY_KEYS
from confwarden.sources.snapshots import entities_as_of, stamped
from confwarden.sources.tenant_pages import read_tenant_pages
from confwarden.standins import entities as e
from confwarden.streaming import (
    incremental,
    page_stream,
    read_batches,
    stream_dead_permissions,
    stream_dead_policies,
    stream_plan,
    stream_sticky_flag,
)

QUERIES = {}

TEMPLATES = ("-building", "-machinery", "sidecar", "reset")
PATTERN = "-building$"
MODE_PATH = f"$.attributes['{fixed.TOKEN_MODE_ATTRIBUTE}']"
RUN_TIME = "2024-01-01 00:00:00"


def query(f):
    """Register ``f`` under its name; a trailing underscore sets it apart from an operator."""
    QUERIES[f.__name__.rstrip("_")] = f
    return f


# Shared steps --------------------------------------------------------------------
def _all_roles(spark, sf):
    return roles.all_roles(e.realm_roles(spark, sf), e.client_roles(spark, sf))


def _catalogue(spark, sf):
    return roles.role_catalogue(e.realm_roles(spark, sf), e.client_roles(spark, sf))


def _dead(spark, sf, *carried):
    return liveness.dead_policies(e.refs(spark, sf, *carried), _all_roles(spark, sf), *carried)


def _orphaned(spark, sf, dead):
    return liveness.dead_permissions(e.assoc(spark, sf), dead, "ptype")


def _findings(spark, sf):
    """Both kinds of findings, with the first kind landed for the second to read."""
    dead = land(_dead(spark, sf), f"{work_folder(spark, 'findings')}/dead_policy")
    orphaned = _orphaned(spark, sf, dead).withColumnRenamed("ptype", "type")
    return all_findings(
        dead.withColumn("policy_id", F.col("policy_id").cast("string")), orphaned
    )


def _json_pages(df, path):
    """Export ``df`` as JSON text, one document per line."""
    df.write.json(path)
    return path


# Scans ---------------------------------------------------------------------------
@query
def scan_entities(spark, sf):
    listed = {
        "realm": e.realms(spark, sf),
        "client": e.clients(spark, sf),
        "realm_role": e.realm_roles(spark, sf),
        "client_role": e.client_roles(spark, sf),
        "policy": e.policies(spark, sf),
        "permission_assoc": e.assoc(spark, sf),
    }
    counted = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        for name, df in listed.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def scan_json_pages(spark, sf):
    """Policies exported to JSON and read back with the explicit schema."""
    path = _json_pages(e.policy_documents(spark, sf), f"{work_folder(spark, 'export')}/policy")
    listed = refs.with_role_ids(read_pages(spark, "policy", path))
    return listed.select(
        "realm", "client_uuid", "policy_id", "type", F.size("role_ids").cast("long").alias("n_refs")
    )


@query
def scan_policies_by_type(spark, sf):
    orders = e.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS policy_id", "o_custkey AS client_uuid", f"{e.POLICY_TYPE} AS type"
    )
    return refs.policies_of_type(orders, fixed.ROLE_POLICY).select("policy_id", "client_uuid")


@query
def scan_clients_pruned(spark, sf):
    return e.clients(spark, sf).select("client_uuid", "client_id")


@query
def complete_refs(spark, sf):
    """Open orders come without a list, which is in the detail record.

    The documents are landed first, as an export would be.
    """
    folder = work_folder(spark, "details")
    documents = land(e.policy_documents(spark, sf), f"{folder}/policy")
    status = e.table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey AS string) AS policy_id", "o_orderstatus = 'O' AS open"
    )
    whole = refs.with_role_ids(
        refs.policies_of_type(documents, fixed.ROLE_POLICY).join(status, "policy_id")
    )
    listed = whole.selectExpr(*refs.POLICY_KEY, "if(open, cast(array() AS array<string>), role_ids) AS role_ids")
    details = whole.filter("open").selectExpr(
        *refs.POLICY_KEY,
        "cast(NULL AS map<string,string>) AS config",
        "transform(role_ids, x -> struct(x AS id)) AS roles",
    )
    edges = refs.complete_role_refs(listed, details)
    return edges.groupBy("policy_id").agg(F.count("*").alias("n_refs"))


@query
def target_realms(spark, sf):
    """Each order is a request whose target list names realms, untidily."""
    lists = e.table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(
            F.lit(" NATION_"),
            F.col("o_custkey") % 25,
            F.lit(",NATION_"),
            F.length("o_orderpriority"),
            F.lit(",,\tNATION_"),
            F.col("o_custkey") % 25,
            F.lit(" , NATION_0 "),
        ).alias("targets"),
    )
    return clients.drop_reserved(explode_targets(lists, "targets", ["o_orderkey"]), e.RESERVED)


@query
def incomplete_exports_(spark, sf):
    """Customers play tenants that announce their orders; orders without lines did not arrive."""
    orders = e.table(spark, sf, "orders").selectExpr(
        "cast(o_custkey AS string) AS realm", "o_custkey AS client_uuid", "o_orderkey AS policy_id"
    )
    lines = e.table(spark, sf, "lineitem").selectExpr("l_orderkey AS policy_id")
    manifest = orders.groupBy("realm").agg(F.count("*").alias("expected"))
    arrived = orders.join(lines.distinct(), "policy_id", "left_semi")
    return incomplete_exports(manifest.withColumn("entity", F.lit("policy")), {"policy": arrived})


# Filters -------------------------------------------------------------------------
@query
def filter_reserved(spark, sf):
    return clients.drop_reserved(e.clients(spark, sf), e.RESERVED).select(*CLIENT_KEY)


@query
def filter_client_regex(spark, sf):
    return clients.matching_clients(e.clients(spark, sf), PATTERN).select("client_uuid", "client_id")


@query
def filter_authz_enabled(spark, sf):
    return clients.authz_clients(e.clients(spark, sf)).select("client_uuid")


@query
def split_authz_enabled(spark, sf):
    return clients.split_by_authz(e.clients(spark, sf)).select("client_uuid", "status")


def _holed_refs(spark, sf):
    """A list per line, in which the part of a returned line is null and an open line's
    supplier empty."""
    return e.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS policy_id",
        "l_linenumber",
        """array(if(l_returnflag = 'R', NULL, cast(l_partkey AS string)),
                 if(l_linestatus = 'O', '', cast(l_suppkey AS string))) AS ids""",
    )


@query
def clean_refs(spark, sf):
    return _holed_refs(spark, sf).select(
        "policy_id", "l_linenumber", F.size(clean_ids(F.col("ids"))).cast("long").alias("n_refs")
    )


@query
def has_refs(spark, sf):
    cleaned = _holed_refs(spark, sf).withColumn("role_ids", clean_ids(F.col("ids")))
    return refs.has_refs(cleaned).select("policy_id", "l_linenumber")


@query
def needs_patch(spark, sf):
    flag = (
        F.when(F.col("segment") == "building", F.create_map(F.lit(fixed.TOKEN_MODE_ATTRIBUTE), F.lit("true")))
        .when(F.col("segment") == "machinery", F.create_map(F.lit(fixed.TOKEN_MODE_ATTRIBUTE), F.lit("false")))
        .when(F.col("segment") == "furniture", F.create_map(F.lit("other"), F.lit("true")))
    )
    return clients.needs_patch(e.clients(spark, sf).withColumn("attributes", flag)).select("client_uuid")


@query
def clients_with_findings(spark, sf):
    return liveness.clients_with_findings(_dead(spark, sf))


# Projections and nested edits ------------------------------------------------------
@query
def flatten_policies(spark, sf):
    return refs.flatten_policies(e.policies(spark, sf))


@query
def decode_role_refs(spark, sf):
    listed = refs.with_role_ids(e.policy_documents(spark, sf))
    return refs.explode_refs(listed.select("policy_id", "role_ids")).drop("refs")


@query
def decode_assoc_refs(spark, sf):
    """Lists of bare ids or, for low priority, of objects, with blanks to be dropped."""
    policy = F.col("policy_id").cast("string")
    bare = F.to_json(F.array(F.lit(""), policy))
    objects = F.to_json(F.array(F.struct(policy.alias("id"), F.lit("role").alias("type"))))
    low = F.col("permission_id").endswith("5-LOW")
    listed = e.assoc(spark, sf).select(
        "permission_id",
        decode_assoc_ids(F.when(low, objects).otherwise(bare)).alias("policy_ids"),
    )
    return refs.explode_refs(listed, "policy_ids", "policy_id").drop("refs")


@query
def explode_refs(spark, sf):
    """Every order's list of parts, one row per entry."""
    lists = e.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("policy_id"))
    return refs.explode_refs(lists.agg(F.collect_list("l_partkey").alias("role_ids")))


@query
def map_upsert_(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return e.table(spark, sf, "events").select(
        "event_id", F.explode(map_upsert(props, "k2", "true")).alias("key", "value")
    )


@query
def nested_patch(spark, sf):
    """Two mappers per line, named by its flags; those named R and A are patched."""
    old = F.create_map(F.lit(fixed.CLAIM_KEY), F.lit("false"))
    config = F.when(F.col("l_quantity") > 25, old).cast("map<string,string>")
    empty = F.lit(None).cast("string")

    def mapper(name):
        return F.struct(
            F.col(name).alias("name"),
            empty.alias("protocol"),
            empty.alias("protocol_mapper"),
            F.lit(None).cast("boolean").alias("consent_required"),
            config.alias("config"),
        )

    mappers = F.array(mapper("l_returnflag"), mapper("l_linestatus"))
    patched = patch_mappers(mappers, ("R", "A"), fixed.CLAIM_KEY, "true")
    return (
        e.table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", F.explode(patched).alias("m"))
        .select(
            "l_orderkey",
            "l_linenumber",
            F.col("m.name").alias("name"),
            F.col("m.config").getItem(fixed.CLAIM_KEY).alias("claim"),
        )
    )


@query
def policy_patch(spark, sf):
    patched = map_upsert(F.col("config"), fixed.FETCH_ROLES_KEY, "false")
    return e.migration_policies(spark, sf).select("policy_id", F.explode(patched).alias("key", "value"))


@query
def insert_missing(spark, sf):
    lacking = children.parents_lacking(
        e.table(spark, sf, "conversations"), ["conv_id"], F.col("role") == "system"
    )
    added = lacking.withColumn("mapper", mapper_literal(fixed.SUB_MAPPER))
    return added.select(
        "conv_id", F.col("mapper.name").alias("name"), F.col("mapper.protocol").alias("protocol")
    )


@query
def insert_missing_children(spark, sf):
    """Clients without a pending order."""
    pending = e.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    return children.missing_children(
        e.clients(spark, sf).select("client_uuid"),
        pending.select(F.col("o_custkey").alias("client_uuid")),
        ["client_uuid"],
    )


@query
def default_values(spark, sf):
    blanked = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return e.table(spark, sf, "events").select(
        "event_id",
        blank_to(blanked, F.lit("d")).alias("v"),
        alternative(F.col("event_type") == "click", F.lit(None)).alias("clicked"),
    )


@query
def expand_targets(spark, sf):
    """Customers play tenants."""
    tenants = e.table(spark, sf, "customer").select(F.col("c_name").alias("realm"))
    return clients.expand_targets(
        clients.drop_reserved(tenants, "Customer#000000000"), fixed.CLIENT_TEMPLATES
    )


# Joins ---------------------------------------------------------------------------
@query
def ref_liveness(spark, sf):
    return liveness.ref_liveness(e.refs(spark, sf), _catalogue(spark, sf)).select(
        "policy_id", "role_id", "alive"
    )


@query
def assoc_deadness(spark, sf):
    return liveness.assoc_deadness(e.assoc(spark, sf), _dead(spark, sf)).select(
        "permission_id", "policy_id", "is_dead"
    )


def _done(spark, sf):
    return e.clients(spark, sf).filter(F.col("segment") == "household")


@query
def pending_clients(spark, sf):
    return clients.pending(e.scope(spark, sf), _done(spark, sf), CLIENT_KEY).select("client_uuid")


def _targets(spark, sf):
    tenants = clients.drop_reserved(e.realms(spark, sf), e.RESERVED)
    return clients.expand_targets(tenants, TEMPLATES)


@query
def lookup_client(spark, sf):
    return clients.lookup_client(_targets(spark, sf), e.migration_clients(spark, sf)).select(
        "realm", "client_id", "client_uuid"
    )


@query
def missing_targets(spark, sf):
    return clients.missing_targets(_targets(spark, sf), e.migration_clients(spark, sf))


@query
def upsert_clients(spark, sf):
    """Wanted: all but the building customers, and all suppliers.  There: positive balances."""
    everyone = e.migration_clients(spark, sf).withColumn("client_id", F.col("label"))
    supplier = e.with_realm(e.table(spark, sf, "supplier"), spark, sf, "s_nationkey").select(
        "realm", F.col("s_name").alias("client_id")
    )
    wanted = everyone.filter(F.col("segment") != "building").select("realm", "client_id")
    plan = ensure_clients(wanted.unionByName(supplier), everyone.filter(F.col("balance") > 0))
    return plan.select(
        "realm",
        "client_id",
        "action",
        "set_attribute",
        "add_mapper",
        F.array_join("grants", ",").alias("grants"),
        F.get_json_object("body", MODE_PATH).alias("enabled"),
    )


@query
def grant_roles(spark, sf):
    suppliers = e.table(spark, sf, "supplier")
    held = suppliers.filter(F.col("s_acctbal") > 0).select("s_suppkey", F.lit("admin").alias("role"))
    return children.grant_missing(suppliers, held, ["s_suppkey"], fixed.GRANTED_ROLES)


# Aggregations --------------------------------------------------------------------
@query
def ref_counts(spark, sf):
    return liveness.ref_counts(e.refs(spark, sf), _catalogue(spark, sf)).select(
        "policy_id", "total", "alive"
    )


@query
def dead_policies(spark, sf):
    return _dead(spark, sf)


@query
def dead_permissions(spark, sf):
    return _orphaned(spark, sf, _dead(spark, sf))


@query
def role_count(spark, sf):
    return roles.role_count(_all_roles(spark, sf))


@query
def role_catalogue(spark, sf):
    return _catalogue(spark, sf)


@query
def findings_by_client(spark, sf):
    return counts.findings_by_client(e.scope(spark, sf), _findings(spark, sf)).select(
        "client_uuid", "phase", "n"
    )


@query
def policies_per_client(spark, sf):
    return counts.policies_per_client(e.scope(spark, sf), e.policies(spark, sf)).select("client_uuid", "n")


@query
def batch_plan(spark, sf):
    findings = land(_findings(spark, sf), work_folder(spark, "batch"))
    numbered = batches.number_batches(findings, [*CLIENT_KEY, "phase"], "target_id", 2)
    return numbered.select("client_uuid", "phase", "target_id", "batch_no")


@query
def run_summary(spark, sf):
    folder = work_folder(spark, "summary")
    dead = land(_dead(spark, sf), f"{folder}/dead_policy")
    tenants = clients.drop_reserved(e.realms(spark, sf), e.RESERVED)
    return counts.run_summary(
        tenants, e.scope(spark, sf), dead, _orphaned(spark, sf, dead), _final_outcomes(spark, sf)
    )


# Sinks ---------------------------------------------------------------------------
@query
def delete_plan_(spark, sf):
    """The plan written by tenant and read back."""
    path = f"{work_folder(spark, 'plan')}/delete_plan"
    plan = delete_plan(_findings(spark, sf))
    write_plan(plan, path)
    return spark.read.schema(plan.schema).parquet(path).select("resource_path", "phase", "apply")


@query
def patch_plan_body(spark, sf):
    """Bodies of all clients, read back."""
    body = patch_clients(e.migration_clients(spark, sf), "false")
    return body.select(
        "client_uuid",
        F.get_json_object("body", MODE_PATH).alias("enabled"),
        F.get_json_object("body", "$.attributes.owner").alias("owner"),
        F.get_json_object("body", "$.protocolMappers[0].name").alias("first_mapper"),
        F.get_json_object("body", f"$.protocolMappers[0].config['{fixed.CLAIM_KEY}']").alias("first_claim"),
        "changed",
    )


@query
def whole_policy_body(spark, sf):
    """Every order as a policy document with fields outside the schema, edited in place."""
    document = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_orderpriority").alias("logic"),
            F.col("o_totalprice").alias("weight"),
            F.create_map(F.lit("owner"), F.col("o_orderstatus")).alias("config"),
        )
    )
    body = e.table(spark, sf, "orders").select("o_orderkey", edited_policy(document, "true").alias("body"))
    return body.select(
        F.col("o_orderkey").alias("policy_id"),
        F.get_json_object("body", "$.logic").alias("logic"),
        F.get_json_object("body", "$.weight").cast("double").alias("weight"),
        F.get_json_object("body", "$.config.owner").alias("owner"),
        F.get_json_object("body", "$.config.fetchRoles").alias("fetch_roles"),
    )


@query
def page_of_policies(spark, sf):
    return batches.page(e.policies(spark, sf).select("policy_id"), ["policy_id"], 100, 100)


@query
def finding_log_(spark, sf):
    dead = _dead(spark, sf, "client_id", "name", "o_orderdate")
    found = dead.selectExpr("*", "'1' AS phase", "'role' AS type", "policy_id AS target_id")
    return finding_log(found, F.col("o_orderdate")).select("policy_id", "msg")


def _codes(spark, sf):
    code = (
        F.when(F.col("event_type") == "purchase", 204)
        .when(F.col("event_type") == "view", 404)
        .when(F.col("event_type") == "click", 401)
        .when(F.col("event_type") == "signup", 503)
        .otherwise(400)
    )
    return e.table(spark, sf, "events").select("event_id", code.alias("http_code"))


def _final_outcomes(spark, sf):
    return _codes(spark, sf).select(final_outcome(F.col("http_code")).alias("outcome"))


@query
def outcome_class(spark, sf):
    return _codes(spark, sf).select(
        "event_id",
        http_outcome(F.col("http_code")).alias("outcome"),
        http_outcome(F.col("http_code"), deleting=False).alias("read_outcome"),
    )


@query
def outcome_counts(spark, sf):
    return counts.outcome_counts(_final_outcomes(spark, sf))


@query
def ledger_append(spark, sf):
    """A run over one kind of client, then a run over all that are left."""
    path = f"{work_folder(spark, 'ledger')}/run_ledger"
    at = F.lit(RUN_TIME)
    scope = e.scope(spark, sf).withColumn("client_uuid", F.col("client_uuid").cast("string"))
    first = clients.matching_clients(scope, PATTERN)
    ledger = append_ledger(done_rows(first, "run-1", at), path)
    rest = land(clients.pending(scope, ledger, CLIENT_KEY), f"{path}-rest")
    ledger = append_ledger(done_rows(rest, "run-2", at), path)
    return ledger.select("client_uuid", "run_id", "status")


@query
def replay_dedup(spark, sf):
    """A plan written, and written again: the second time adds nothing."""
    folder = work_folder(spark, "replay")
    path = f"{folder}/delete_plan"
    plan = land(delete_plan(_findings(spark, sf)), f"{folder}/plan")
    write_plan(plan, path)
    again = unseen(plan, spark.read.schema(plan.schema).parquet(path))
    write_plan(again, path)
    return spark.read.schema(plan.schema).parquet(path).select("resource_path")


@query
def ledger_compact(spark, sf):
    """Five runs, the first of them repeated by later ones, in a ledger made compact twice."""
    path = f"{work_folder(spark, 'ledger')}/run_ledger"
    scope = e.scope(spark, sf).withColumn("client_uuid", F.col("client_uuid").cast("string"))
    mine = clients.matching_clients(scope, PATTERN)
    for run, rows in enumerate((mine, scope, mine, scope.filter("balance > 5000"), mine)):
        at = F.lit(f"2024-01-0{run + 1} 00:00:00")
        ledger = record_run(done_rows(rows, f"run-{run}", at), path, every=2)
    latest = F.max(F.struct("ts", "run_id"))["run_id"].alias("run_id")
    return ledger.groupBy("client_uuid", "status").agg(latest)


@query
def page_by_index(spark, sf):
    """A page from the middle of all policies, through an index of ranges."""
    path = work_folder(spark, "pages")
    policies = e.policies(spark, sf).select("policy_id", "name")
    batches.write_pages(policies, ["policy_id"], path, ranges=32)
    deep = batches.read_page(spark, path, policies.schema, ["policy_id"], 500, 100)
    return deep.select("policy_id")


# Functions -----------------------------------------------------------------------
@query
def scalar_functions(spark, sf):
    """The remaining scalar functions, on every event."""
    blank = F.when(F.col("event_type") != "view", "")
    ids = F.split(F.concat_ws(",", "event_type", blank, F.col("user_id")), ",")
    listed = F.when(F.col("event_type") == "click", F.concat(F.lit("["), "props", F.lit("]")))
    kept = F.filter(ids, lambda x: x != "")
    untidy = F.concat(F.lit("\t "), F.col("event_type"), F.lit(" \n"))
    phase = F.when(F.col("event_type") == "click", "2-scope").when(
        F.col("event_type") == "view", "9"
    ).otherwise("1")
    cursor = cursor_text(phase, F.col("user_id"))
    back = parse_cursor(cursor)
    return e.table(spark, sf, "events").select(
        "event_id",
        F.size(ids).cast("long").alias("n_ids"),
        F.col("event_type").rlike("^(sign|pur)").alias("matches"),
        F.from_json("props", "k long")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"))).alias("as_text"),
        F.array_join(F.transform(kept, F.upper), ",").alias("joined"),
        F.startswith(F.coalesce(listed, "props"), F.lit("[")).alias("is_array"),
        F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("none")).alias("or_else"),
        tab_separated(F.col("event_id"), F.col("event_type")).alias("tsv"),
        F.from_json("props", "map<string,string>")["k"].alias("k_text"),
        trim_space(untidy).alias("trimmed"),
        cursor.alias("cursor"),
        back["phase"].alias("phase"),
        back["offset"].alias("position"),
        utc_stamp(F.col("ts")).alias("stamp"),
        F.left(F.col("event_type"), F.lit(2)).alias("head"),
        F.right(F.col("event_type"), F.lit(2)).alias("tail"),
        F.startswith(F.col("event_type"), F.lit("p")).alias("starts"),
    )


# Sessions ------------------------------------------------------------------------
@query
def sticky_flag(spark, sf):
    events = e.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    flagged = sticky.sticky_flag(
        events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase"
    )
    return flagged.select("event_id", "flag")


# Jobs ----------------------------------------------------------------------------
@query
def audit_summary(spark, sf):
    """The whole audit over documents, for matching clients an earlier run has not done."""
    result = _audit(spark, sf)
    return result.summary


def _policy_outcomes(documents):
    """Outcomes of every role policy's path, most of which are in no plan."""
    third = F.col("policy_id").cast("long") % 3
    code = F.when(third == 0, 204).when(third == 1, 404).otherwise(400)
    policies = documents.filter(F.col("type") == fixed.ROLE_POLICY)
    path = policy_path(F.col("realm"), F.col("client_uuid"), F.col("policy_id"))
    return counts.outcomes_by_path(policies.select(path.alias("resource_path"), code.alias("http_code")))


def _audit(spark, sf):
    at = F.lit(RUN_TIME)
    documents = e.policy_documents(spark, sf).unionByName(e.permission_documents(spark, sf))
    done = e.clients(spark, sf).filter(F.col("balance") < 1000)
    return audit(
        Entities(
            realms=e.realms(spark, sf).select("realm"),
            clients=e.client_documents(spark, sf),
            roles=e.role_documents(spark, sf),
            policies=documents,
            associations=e.association_documents(spark, sf),
            ledger=done_rows(done, "run-0", at),
            outcomes=_policy_outcomes(documents),
        ),
        AuditConfig(pattern=PATTERN, reserved=e.RESERVED),
    )


def _guarded(spark, sf):
    """An audit with a manifest: one region announces more roles than came, one no policies."""
    folder = work_folder(spark, "guarded")
    delivered = {
        "client": e.client_documents(spark, sf),
        "role": e.role_documents(spark, sf),
        "policy": land(
            e.policy_documents(spark, sf).unionByName(e.permission_documents(spark, sf)), f"{folder}/policy"
        ),
        "permission_assoc": e.association_documents(spark, sf),
    }
    tenants = e.table(spark, sf, "nation").selectExpr("n_name AS realm", "n_regionkey AS region")

    def announced(name):
        n = delivered[name].groupBy("realm").agg(F.countDistinct(*ENTITY_KEYS[name]).alias("n"))
        return tenants.join(n, "realm", "left").selectExpr(
            "realm", "region", f"'{name}' AS entity", "coalesce(n, 0L) AS n"
        )

    manifest = reduce(DataFrame.unionByName, map(announced, delivered)).filter(
        (F.col("region") != 3) | (F.col("entity") != "policy")
    )
    more = "n + if(region = 2 AND entity = 'role', 1L, 0L) AS expected"
    return audit(
        Entities(
            realms=tenants.select("realm"),
            clients=delivered["client"],
            roles=delivered["role"],
            policies=delivered["policy"],
            associations=delivered["permission_assoc"],
            manifest=land(manifest.selectExpr("realm", "entity", more), f"{folder}/manifest"),
        ),
        AuditConfig(pattern=PATTERN, reserved=e.RESERVED),
    )


@query
def rejected_tenants(spark, sf):
    return _guarded(spark, sf).rejected.select("realm", "entity", "expected", "actual", "reason")


@query
def audit_guarded(spark, sf):
    """The named findings of an audit that leaves out tenants whose export is not whole."""
    return _guarded(spark, sf).findings.select("realm", "client_id", "phase", "target_id", "name")


def _broken(spark, sf):
    """An audit of pages by tenant; in one region the lines of urgent policies have been cut off."""
    folder = work_folder(spark, "broken")
    cut = e.table(spark, sf, "nation").selectExpr("n_name AS realm", "n_regionkey = 2 AS cut")
    documents = e.policy_documents(spark, sf).join(cut, "realm")
    line = F.to_json(F.struct("client_uuid", "policy_id", "name", "type", "config"))
    torn = F.col("cut") & (F.col("name") < "2")
    lines = documents.select("realm", F.when(torn, F.left(line, F.lit(30))).otherwise(line).alias("line"))
    lines.hint("rebalance", "realm").write.partitionBy("realm").text(f"{folder}/export")
    policies, broken = read_tenant_pages(spark, "policy", f"{folder}/export", folder)
    return audit(
        Entities(
            realms=e.realms(spark, sf).select("realm"),
            clients=e.client_documents(spark, sf),
            roles=e.role_documents(spark, sf),
            policies=policies,
            broken=broken,
        ),
        AuditConfig(pattern="", reserved=e.RESERVED),
    )


@query
def broken_pages(spark, sf):
    """The tenants that broken lines keep out, and how many lines."""
    return _broken(spark, sf).rejected.select("realm", "entity", "actual", "reason")


@query
def audit_readable(spark, sf):
    """What the audit finds for all other tenants."""
    return _broken(spark, sf).dead_policies.select("realm", "client_uuid", "policy_id", "refs")


@query
def audit_as_of(spark, sf):
    """Two exports that overlap: the second, without any role, has come in full for some tenants.

    Those are judged by it alone, the others by the first.
    """
    folder = work_folder(spark, "snapshots")
    tenants = e.table(spark, sf, "nation").selectExpr("n_name AS realm", "n_regionkey AS region")
    documents = land(e.policy_documents(spark, sf), f"{folder}/documents")
    found = e.client_documents(spark, sf)

    def twice(df):
        return stamped(df, 1).unionByName(stamped(df, 2))

    roles = stamped(e.role_documents(spark, sf), 1)
    late = twice(documents).join(tenants, "realm").filter((F.col("snapshot_id") == 1) | (F.col("region") != 2) | (F.col("name") < "3"))
    delivered = {
        "client": land(twice(found), f"{folder}/client"),
        "role": land(roles, f"{folder}/role"),
        "policy": land(late.drop("region"), f"{folder}/policy"),
    }

    def announced(name, df, snapshot):
        n = df.groupBy("realm").agg(F.countDistinct(*ENTITY_KEYS[name]).alias("n"))
        rows = tenants.select("realm").join(n, "realm", "left")
        return stamped(rows.selectExpr("realm", f"'{name}' AS entity", "coalesce(n, 0L) AS expected"), snapshot)

    whole = {"client": found, "role": e.role_documents(spark, sf), "policy": documents}
    parts = [announced(name, df, 1) for name, df in whole.items()]
    parts += [announced(name, df.limit(0) if name == "role" else df, 2) for name, df in whole.items()]
    manifest = land(reduce(DataFrame.unionByName, parts), f"{folder}/manifest")
    entities = Entities(tenants.select("realm"), delivered["client"], delivered["role"], delivered["policy"])
    taken, _ = entities_as_of(entities, manifest)
    dead = audit(taken, AuditConfig(pattern="", reserved=e.RESERVED)).dead_policies
    return dead.select("realm", "client_uuid", "policy_id", "refs")


@query
def audit_plan(spark, sf):
    """The delete plan of the same audit, with its batches."""
    return _audit(spark, sf).plan.select("resource_path", "phase", "action", "apply", "batch_no")


def _token_mode(spark, sf, mode):
    return plan_token_mode(
        e.realms(spark, sf),
        e.migration_clients(spark, sf),
        e.migration_policies(spark, sf),
        templates=TEMPLATES,
        mode=mode,
        reserved=e.RESERVED,
        unchanged=True,
    )


def _token_mode_rows(plan, value):
    return plan.clients.select(
        "realm",
        "client_uuid",
        "insert_sub",
        F.get_json_object("body", MODE_PATH).alias("enabled"),
        F.when(F.col("status") == "process", value).alias("fetch_roles"),
        "changed",
    )


@query
def token_mode_plan(spark, sf):
    return _token_mode_rows(_token_mode(spark, sf, "lightweight"), F.lit("true"))


@query
def token_mode_plan_regular(spark, sf):
    return _token_mode_rows(_token_mode(spark, sf, "regular"), F.lit("false"))


@query
def token_mode_policies(spark, sf):
    return _token_mode(spark, sf, "lightweight").policies.select(
        F.col("target_id").alias("policy_id"),
        F.get_json_object("body", "$.config.fetchRoles").alias("fetch_roles"),
        F.get_json_object("body", "$.config.logic").alias("logic"),
        "changed",
    )


# Streams -------------------------------------------------------------------------
def _policy_stream(spark, sf, folder):
    pages = _json_pages(e.policy_documents(spark, sf), f"{folder}/policy")
    scope = clients.authz_clients(clients.drop_reserved(e.client_documents(spark, sf), e.RESERVED))
    scope = land(scope.select(*CLIENT_KEY, "client_id"), f"{folder}/client")
    known = land(e.role_documents(spark, sf), f"{folder}/role")
    dead = stream_dead_policies(
        page_stream(spark, "policy", pages, files_per_batch=4), scope, known, folder, "run-1"
    )
    return dead, scope


@query
def stream_policies(spark, sf):
    dead, _ = _policy_stream(spark, sf, work_folder(spark, "stream"))
    return dead.select("realm", "client_uuid", "policy_id", "refs")


@query
def stream_permissions(spark, sf):
    folder = work_folder(spark, "stream")
    dead, scope = _policy_stream(spark, sf, folder)
    dead = land(dead, f"{folder}/dead")
    pages = _json_pages(e.permission_documents(spark, sf), f"{folder}/permission")
    associations = land(e.association_documents(spark, sf), f"{folder}/association")
    found = stream_dead_permissions(
        page_stream(spark, "policy", pages, files_per_batch=4), scope, dead, folder, "run-1", associations
    )
    return found.select("realm", "client_uuid", "permission_id", F.col("type").alias("ptype"), "refs")


def _late_policies(spark, sf):
    """Findings of streams in which permissions arrive a run before all policies."""
    folder = work_folder(spark, "stream")
    pages = _json_pages(e.permission_documents(spark, sf), f"{folder}/permission")
    associations = land(e.association_documents(spark, sf), f"{folder}/association")
    scope = clients.authz_clients(clients.drop_reserved(e.client_documents(spark, sf), e.RESERVED))
    scope = land(scope.select(*CLIENT_KEY, "client_id"), f"{folder}/early")
    nothing = spark.createDataFrame([], "realm string, client_uuid string, policy_id string, refs long")

    def permissions(dead):
        arrived = page_stream(spark, "policy", pages, files_per_batch=4)
        return stream_dead_permissions(arrived, scope, dead, folder, "run-1", associations)

    permissions(nothing)
    dead = land(_policy_stream(spark, sf, folder)[0], f"{folder}/dead")
    return dead, permissions(dead)


@query
def stream_late_policies(spark, sf):
    found = _late_policies(spark, sf)[1]
    return found.select("realm", "client_uuid", "permission_id", F.col("type").alias("ptype"), "refs")


@query
def stream_plan_(spark, sf):
    """The delete plan of all that has landed."""
    plan = stream_plan(*_late_policies(spark, sf))
    return plan.select("resource_path", "phase", "apply", "batch_no")


def _more_pages(df, path):
    df.write.mode("append").json(path)
    return path


def _scope_documents(spark, sf, path):
    mine = clients.authz_clients(clients.drop_reserved(e.client_documents(spark, sf), e.RESERVED))
    return land(mine.select(*CLIENT_KEY, "client_id"), path)


def _blank(documents, where):
    """``documents`` whose lists are missing where a condition holds, as an export may have them."""
    return documents.withColumn("config", F.when(~where, F.col("config")))


@query
def stream_late_scope(spark, sf):
    """All policies land while few clients are looked at; the next run looks at all clients."""
    folder = work_folder(spark, "stream")
    scope = _scope_documents(spark, sf, f"{folder}/client")
    known = land(e.role_documents(spark, sf), f"{folder}/role")
    pages = _json_pages(e.policy_documents(spark, sf), f"{folder}/pages")
    state = incremental.policy_state(spark, folder)
    early = clients.matching_clients(scope, PATTERN)
    incremental.advance_policies(state, known, page_stream(spark, "policy", pages, files_per_batch=4))
    land(incremental.dead_policies_of(state, early), f"{folder}/first")
    incremental.advance_policies(state, known, page_stream(spark, "policy", pages, files_per_batch=4))
    return incremental.dead_policies_of(state, scope).select("realm", "client_uuid", "policy_id", "refs")


def _three_runs(spark, sf, folder):
    """Policies arrive in three runs, some twice, while roles come and go."""
    documents = land(e.policy_documents(spark, sf), f"{folder}/documents")
    parts = [F.col("name") < "2", F.col("name") < "4", F.col("name") >= "3"]
    roles = [
        e.realm_roles(spark, sf).selectExpr("realm", "cast(role_id AS string) AS role_id"),
        documents.selectExpr("realm", "policy_id AS role_id").unionByName(
            e.client_roles(spark, sf).selectExpr("realm", "cast(role_id AS string) AS role_id")
        ),
        e.role_documents(spark, sf),
    ]
    state = incremental.policy_state(spark, folder)
    for part, known in zip(parts, roles, strict=True):
        pages = _more_pages(documents.filter(part), f"{folder}/pages")
        incremental.advance_policies(state, known, page_stream(spark, "policy", pages, files_per_batch=8))
    return state


@query
def stream_counts(spark, sf):
    """Counts carried from run to run, corrected where the role catalogue changes."""
    folder = work_folder(spark, "stream")
    state = _three_runs(spark, sf, folder)
    scope = _scope_documents(spark, sf, f"{folder}/client")
    return incremental.dead_policies_of(state, scope).select("realm", "client_uuid", "policy_id", "refs")


def _late_details(spark, sf, folder):
    """Policies of two priorities come without a list; detail records follow a run later."""
    documents = land(e.policy_documents(spark, sf), f"{folder}/documents")
    missing = F.col("name") < "3"
    known = land(e.role_documents(spark, sf), f"{folder}/role")
    pages = _json_pages(_blank(documents, missing), f"{folder}/pages")
    state = incremental.policy_state(spark, folder)
    incremental.advance_policies(state, known, page_stream(spark, "policy", pages, files_per_batch=4))
    waiting = land(incremental.pending_records(state, None), f"{folder}/waiting")
    detail = documents.filter(missing & (F.col("type") == fixed.ROLE_POLICY)).select(*refs.POLICY_KEY, "config")
    details = _json_pages(detail, f"{folder}/detail")
    incremental.advance_policies(
        state,
        known,
        page_stream(spark, "policy", pages, files_per_batch=4),
        page_stream(spark, "policy_detail", details, files_per_batch=4),
    )
    return state, waiting


@query
def stream_late_details(spark, sf):
    folder = work_folder(spark, "stream")
    state, _ = _late_details(spark, sf, folder)
    scope = _scope_documents(spark, sf, f"{folder}/client")
    return incremental.dead_policies_of(state, scope).select("realm", "client_uuid", "policy_id", "refs")


@query
def stream_pending(spark, sf):
    """Policies that wait for their detail record after the first run."""
    return _late_details(spark, sf, work_folder(spark, "stream"))[1]


def _late_associations(spark, sf):
    """Permissions, then their associations, then the policies these name, a run each."""
    folder = work_folder(spark, "stream")
    scope = _scope_documents(spark, sf, f"{folder}/client")
    known = land(e.role_documents(spark, sf), f"{folder}/role")
    named = _json_pages(e.permission_documents(spark, sf), f"{folder}/permission")
    linked, policies = f"{folder}/association", f"{folder}/policy"
    first, second = incremental.policy_state(spark, folder), incremental.permission_state(spark, folder)
    for spark_path, documents in ((None, None), (linked, e.association_documents), (policies, e.policy_documents)):
        spark.createDataFrame([], schemas.PERMISSION_ASSOC).write.mode("append").json(linked)
        spark.createDataFrame([], schemas.POLICY).write.mode("append").json(policies)
        if documents is not None:
            _more_pages(documents(spark, sf), spark_path)
        incremental.advance_policies(first, known, page_stream(spark, "policy", policies, files_per_batch=4))
        dead = incremental.dead_policies_of(first, None)
        incremental.advance_permissions(
            second,
            dead,
            page_stream(spark, "policy", named, files_per_batch=4),
            page_stream(spark, "permission_assoc", linked, files_per_batch=4),
        )
    return incremental.dead_policies_of(first, scope), incremental.dead_permissions_of(second, scope)


@query
def stream_late_associations(spark, sf):
    found = _late_associations(spark, sf)[1]
    return found.select("realm", "client_uuid", "permission_id", F.col("type").alias("ptype"), "refs")


@query
def replay_plan(spark, sf):
    """Plans of three runs that overlap, each written through the index of what is planned."""
    folder = work_folder(spark, "replay")
    plan = land(delete_plan(_findings(spark, sf)), f"{folder}/whole")
    for part in (F.col("phase") == fixed.POLICY_PHASE, F.col("phase") != "2-scope", F.lit(True)):
        write_unseen(plan.filter(part), f"{folder}/out", every=2)
    return all_planned(spark, f"{folder}/out", plan.schema).select("resource_path", "phase", "apply")


@query
def stream_cursors(spark, sf):
    """How far the policy phase has read, from the ledger its batches wrote."""
    folder = work_folder(spark, "stream")
    _policy_stream(spark, sf, folder)
    ledger = read_batches(spark, f"{folder}/ledger/dead_policy", schemas.RUN_LEDGER)
    return cursors(ledger).select("realm", "client_uuid", "phase", "cursor")


@query
def stream_sticky(spark, sf):
    schema = e.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type").schema
    requests = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    flagged = stream_sticky_flag(
        requests,
        "user_id",
        ["ts", "event_id"],
        F.col("event_type") == "purchase",
        work_folder(spark, "sticky"),
    )
    return flagged.select("event_id", "flag")
