"""Explicit schemas of the exported entities and of the tables the jobs write.

Exports are never read with schema inference: an optional field that happens to be
absent from one export must not change the table.  Extra fields are ignored and
absent ones read as null.
"""

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

MAPPER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("protocol_mapper", T.StringType()),
        T.StructField("consent_required", T.BooleanType()),
        T.StructField("config", STRING_MAP),
    ]
)


def _table(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, B, L, I = T.StringType(), T.BooleanType(), T.LongType(), T.IntegerType()

REALM = _table(("realm", S))
CLIENT = _table(
    ("realm", S),
    ("client_uuid", S),
    ("client_id", S),
    ("authz_enabled", B),
    ("attributes", STRING_MAP),
    ("protocol_mappers", T.ArrayType(MAPPER)),
)
ROLE = _table(("realm", S), ("role_id", S), ("owner_client", S))
POLICY = _table(
    ("realm", S),
    ("client_uuid", S),
    ("policy_id", S),
    ("name", S),
    ("type", S),
    ("config", STRING_MAP),
)
POLICY_DETAIL = _table(
    ("realm", S),
    ("client_uuid", S),
    ("policy_id", S),
    ("config", STRING_MAP),
    ("roles", T.ArrayType(_table(("id", S)))),
)
PERMISSION_ASSOC = _table(
    ("realm", S), ("client_uuid", S), ("permission_id", S), ("policy_id", S)
)
SERVICE_ACCOUNT_ROLE = _table(("realm", S), ("username", S), ("role_name", S))
MANIFEST = _table(("realm", S), ("entity", S), ("expected", L))

RUN_LEDGER = _table(
    ("run_id", S),
    ("realm", S),
    ("client_uuid", S),
    ("phase", S),
    ("offset", L),
    ("status", S),
    ("ts", T.TimestampType()),
)
OUTCOME = _table(("resource_path", S), ("http_code", I))

EXPORTS = {
    "realm": REALM,
    "client": CLIENT,
    "role": ROLE,
    "policy": POLICY,
    "policy_detail": POLICY_DETAIL,
    "permission_assoc": PERMISSION_ASSOC,
    "service_account_role": SERVICE_ACCOUNT_ROLE,
    "manifest": MANIFEST,
    "run_ledger": RUN_LEDGER,
    "outcome": OUTCOME,
}

#: Fields without which a document cannot be told from others.
KEYS = {
    "realm": ("realm",),
    "client": ("realm", "client_uuid", "client_id"),
    "role": ("realm", "role_id"),
    "policy": ("realm", "client_uuid", "policy_id", "type"),
    "policy_detail": ("realm", "client_uuid", "policy_id"),
    "permission_assoc": ("realm", "client_uuid", "permission_id", "policy_id"),
    "manifest": ("realm", "entity"),
    "outcome": ("resource_path",),
}

#: Mappers as documents write them, in the order of ``MAPPER``.
DOCUMENT_MAPPERS = T.ArrayType(
    _table(("name", S), ("protocol", S), ("protocolMapper", S), ("consentRequired", B), ("config", STRING_MAP))
)
