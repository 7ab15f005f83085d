"""Entities derived from the test tables, whole tables throughout.

=================  ==============================================================
realm              nation; ``NATION_0`` plays the reserved tenant
client             customer; fine-grained authorization is a positive balance
realm/client role  a part exists as a role in the realms its key falls to
role policy        an order that is not pending; its references are its lines' parts
other policy       a pending order, never dead
permission         a customer's orders of one priority
=================  ==============================================================

Ids stay the integers of the tables where operators are shown one by one, and become
text where whole documents are built.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confwarden import fixed
from confwarden.operators.clients import authz_clients, drop_reserved

RESERVED = "NATION_0"
PERMISSION = "concat_ws(':', o_custkey, o_orderpriority)"
PERMISSION_TYPE = "if(o_orderpriority IN ('1-URGENT', '2-HIGH'), 'scope', 'resource')"
POLICY_TYPE = "if(o_orderstatus <> 'P', 'role', 'user')"


# Schemas of the tables, so that opening one needs no job to read its footer.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def realms(spark, sf):
    return table(spark, sf, "nation").selectExpr("n_name AS realm", "n_nationkey")


def with_realm(df, spark, sf, key):
    named = table(spark, sf, "nation").selectExpr("n_name AS realm", f"n_nationkey AS {key}")
    return df.join(named, key)


def clients(spark, sf):
    return with_realm(table(spark, sf, "customer"), spark, sf, "c_nationkey").selectExpr(
        "realm",
        "c_custkey AS client_uuid",
        "concat('c', c_custkey, '-', lower(c_mktsegment)) AS client_id",
        "c_acctbal > 0 AS authz_enabled",
        "lower(c_mktsegment) AS segment",
        "c_name AS label",
        "c_acctbal AS balance",
    )


def scope(spark, sf):
    return authz_clients(drop_reserved(clients(spark, sf), RESERVED))


def _roles(spark, sf, modulus):
    """Parts by realm where ``(part key + nation key)`` is a multiple of ``modulus``.

    Written as equality of remainders, so that it is a hash join with the realm table and
    not a product.
    """
    realm = table(spark, sf, "nation").selectExpr(
        "n_name AS realm", f"cast(({modulus} - n_nationkey % {modulus}) % {modulus} AS bigint) AS rest"
    )
    part = table(spark, sf, "part").selectExpr("p_partkey AS role_id", f"p_partkey % {modulus} AS rest")
    return part.join(realm, "rest").select("realm", "role_id")


def realm_roles(spark, sf):
    return _roles(spark, sf, 10)


def client_roles(spark, sf):
    return _roles(spark, sf, 15)


def policies(spark, sf):
    """Role policies of clients in scope."""
    mine = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").selectExpr(
        "o_custkey AS client_uuid", "o_orderkey AS policy_id", "o_orderpriority AS name", "o_orderdate"
    )
    return mine.join(scope(spark, sf).select("realm", "client_uuid", "client_id"), "client_uuid")


def refs(spark, sf, *carried):
    """Edges from role policies to roles."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS policy_id", "l_partkey AS role_id")
    return policies(spark, sf).join(lines, "policy_id").select(
        "realm", "client_uuid", "policy_id", *carried, "role_id"
    )


def assoc(spark, sf):
    """Edges from permissions to policies of every kind."""
    orders = table(spark, sf, "orders").selectExpr(
        "o_custkey AS client_uuid",
        f"{PERMISSION} AS permission_id",
        f"{PERMISSION_TYPE} AS ptype",
        "o_orderkey AS policy_id",
    )
    return orders.join(scope(spark, sf).select("realm", "client_uuid"), "client_uuid").select(
        "realm", "client_uuid", "permission_id", "ptype", "policy_id"
    )


# Whole documents -----------------------------------------------------------------
def _owned(orders, spark, sf):
    """Rows of ``orders`` with the realm of their client."""
    owners = with_realm(table(spark, sf, "customer"), spark, sf, "c_nationkey").selectExpr(
        "realm", "c_custkey AS o_custkey"
    )
    return orders.join(owners, "o_custkey")


def client_documents(spark, sf):
    return clients(spark, sf).selectExpr(
        "realm", "cast(client_uuid AS string) AS client_uuid", "client_id", "authz_enabled"
    )


def role_documents(spark, sf):
    """Realm roles and client roles, as exported: a role of both kinds is there twice."""
    return (
        realm_roles(spark, sf)
        .unionByName(client_roles(spark, sf))
        .selectExpr("realm", "cast(role_id AS string) AS role_id")
    )


def policy_documents(spark, sf):
    """Every order as a policy document with its role list as JSON text.

    A document is one row by nature; its list is the handful of lines of one order.
    """
    lists = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.expr("to_json(collect_list(struct(cast(l_partkey AS string) AS id))) AS roles"))
    )
    return (
        _owned(table(spark, sf, "orders"), spark, sf)
        .join(lists, "o_orderkey", "left")
        .selectExpr(
            "realm",
            "cast(o_custkey AS string) AS client_uuid",
            "cast(o_orderkey AS string) AS policy_id",
            "o_orderpriority AS name",
            f"{POLICY_TYPE} AS type",
            f"if(roles IS NOT NULL, map('{fixed.ROLES_KEY}', roles), NULL) AS config",
        )
    )


def permission_documents(spark, sf):
    """Permissions as documents whose lists are empty: associations are in their own table."""
    named = table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()
    return _owned(named, spark, sf).selectExpr(
        "realm",
        "cast(o_custkey AS string) AS client_uuid",
        f"{PERMISSION} AS policy_id",
        "o_orderpriority AS name",
        f"{PERMISSION_TYPE} AS type",
        "cast(NULL AS map<string,string>) AS config",
    )


def association_documents(spark, sf):
    return _owned(table(spark, sf, "orders"), spark, sf).selectExpr(
        "realm",
        "cast(o_custkey AS string) AS client_uuid",
        f"{PERMISSION} AS permission_id",
        "cast(o_orderkey AS string) AS policy_id",
    )


# Clients to migrate ----------------------------------------------------------------
def _mapper(name, config):
    return (
        f"struct('{name}' AS name, 'openid-connect' AS protocol, 'test-mapper' AS protocol_mapper, "
        f"false AS consent_required, cast({config} AS map<string,string>) AS config)"
    )


def migration_clients(spark, sf):
    """Clients named by realm and segment, with attributes and mappers in every state.

    Many customers share a name; the balance decides which parts of a client are there.
    """
    claim = f"map('{fixed.CLAIM_KEY}', 'true')"
    username = _mapper("username", f"if(balance > 5000, {claim}, NULL)")
    other, sub = _mapper("audience", "map('kept', 'yes')"), _mapper("sub", claim)
    return clients(spark, sf).selectExpr(
        "realm",
        "client_uuid",
        "concat_ws('-', realm, segment) AS client_id",
        "authz_enabled",
        f"""CASE WHEN balance > 5000 THEN map('{fixed.TOKEN_MODE_ATTRIBUTE}', 'true')
                 WHEN balance >= 1000 THEN map('owner', label) END AS attributes""",
        f"""CASE WHEN balance > 5000 THEN array({username}, {sub})
                 WHEN balance >= 1000 THEN array({username}, {other}) END AS protocol_mappers""",
        "label",
        "segment",
        "balance",
    )


def migration_policies(spark, sf):
    """All orders as policies with a small configuration; dear ones already fetch roles."""
    dear = f"map('logic', o_orderstatus, '{fixed.FETCH_ROLES_KEY}', 'true')"
    return _owned(table(spark, sf, "orders"), spark, sf).selectExpr(
        "realm",
        "o_custkey AS client_uuid",
        "o_orderkey AS policy_id",
        "o_orderpriority AS name",
        f"{POLICY_TYPE} AS type",
        f"if(o_totalprice > 250000, {dear}, map('logic', o_orderstatus)) AS config",
    )
