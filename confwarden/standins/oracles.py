"""The same queries in plain SQL over the test tables, for another engine to run."""

BASE = """
WITH realm AS (
  SELECT n_name AS realm, n_nationkey AS nk FROM nation
), client AS (
  SELECT n.realm, c.c_custkey AS client_uuid,
         concat('c', c.c_custkey, '-', lower(c.c_mktsegment)) AS client_id,
         c.c_acctbal > 0 AS authz_enabled, lower(c.c_mktsegment) AS segment,
         c.c_name AS label, c.c_acctbal AS balance
  FROM customer c JOIN realm n ON n.nk = c.c_nationkey
), scope AS (
  SELECT * FROM client WHERE realm <> 'NATION_0' AND authz_enabled
), realm_role AS (
  SELECT realm, p_partkey AS role_id FROM part, realm WHERE (p_partkey + nk) % 10 = 0
), client_role AS (
  SELECT realm, p_partkey AS role_id FROM part, realm WHERE (p_partkey + nk) % 15 = 0
), role AS (
  SELECT * FROM realm_role UNION SELECT * FROM client_role
), pol AS (
  SELECT s.realm, s.client_uuid, s.client_id, o.o_orderkey AS policy_id,
         o.o_orderpriority AS name, o.o_orderdate
  FROM orders o JOIN scope s ON s.client_uuid = o.o_custkey WHERE o.o_orderstatus <> 'P'
), ref AS (
  SELECT p.realm, p.client_uuid, p.policy_id, l.l_partkey AS role_id
  FROM pol p JOIN lineitem l ON l.l_orderkey = p.policy_id
), dead AS (
  SELECT r.realm, r.client_uuid, r.policy_id, count(*) AS refs
  FROM ref r LEFT JOIN role x ON x.realm = r.realm AND x.role_id = r.role_id
  GROUP BY 1, 2, 3 HAVING count(x.role_id) = 0
), assoc AS (
  SELECT s.realm, s.client_uuid, concat(o.o_custkey, ':', o.o_orderpriority) AS permission_id,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'scope' ELSE 'resource' END AS ptype,
         o.o_orderkey AS policy_id
  FROM orders o JOIN scope s ON s.client_uuid = o.o_custkey
), deadperm AS (
  SELECT a.realm, a.client_uuid, a.permission_id, a.ptype, count(*) AS refs
  FROM assoc a LEFT JOIN dead d
    ON d.realm = a.realm AND d.client_uuid = a.client_uuid AND d.policy_id = a.policy_id
  GROUP BY 1, 2, 3, 4 HAVING count(*) = count(d.policy_id)
), finding AS (
  SELECT realm, client_uuid, '1' AS phase, CAST(policy_id AS VARCHAR) AS target_id FROM dead
  UNION ALL
  SELECT realm, client_uuid, concat('2-', ptype), permission_id FROM deadperm
), plan AS (
  SELECT concat('/admin/realms/', realm, '/clients/', client_uuid,
                '/authz/resource-server/policy/', target_id) AS resource_path,
         realm, client_uuid, phase, target_id
  FROM finding
), template AS (
  SELECT unnest(['-building', '-machinery', 'sidecar', 'reset']) AS t
), target AS (
  SELECT realm, CASE WHEN t LIKE '-%' THEN concat(realm, t) ELSE t END AS client_id
  FROM realm, template WHERE realm <> 'NATION_0'
), migration AS (
  SELECT realm, client_uuid, concat(realm, '-', segment) AS client_id, authz_enabled, label, segment,
         balance, balance > 5000 AS high, balance < 1000 AS low
  FROM client
), known AS (
  SELECT * FROM migration m
  WHERE client_uuid = (SELECT min(o.client_uuid) FROM migration o
                       WHERE o.realm = m.realm AND o.client_id = m.client_id)
    AND (realm, client_id) IN (SELECT realm, client_id FROM target)
), code AS (
  SELECT event_id, CASE event_type WHEN 'purchase' THEN 204 WHEN 'view' THEN 404 WHEN 'click' THEN 401
                   WHEN 'signup' THEN 503 ELSE 400 END AS c
  FROM events
), tally AS (
  SELECT count(*) FILTER (c IN (204, 404)) AS ok, count(*) FILTER (c NOT IN (204, 404)) AS fail FROM code
), audited AS (
  SELECT * FROM scope WHERE segment = 'building' AND NOT balance < 1000
)
"""

TOKEN_MODE = """
SELECT realm, client_uuid, NOT high AS insert_sub, '{value}' AS enabled,
       CASE WHEN authz_enabled THEN '{value}' END AS fetch_roles, {changed} AS changed
FROM known
"""

HOLED = """
SELECT l_orderkey AS policy_id, l_linenumber,
       CAST(l_returnflag <> 'R' AS BIGINT) + CAST(l_linestatus <> 'O' AS BIGINT) AS n_refs
FROM lineitem
"""

_SQL = {
    # Scans
    "scan_entities": """
        SELECT 'realm' AS entity, count(*) AS n FROM realm
        UNION ALL SELECT 'client', count(*) FROM client
        UNION ALL SELECT 'realm_role', count(*) FROM realm_role
        UNION ALL SELECT 'client_role', count(*) FROM client_role
        UNION ALL SELECT 'policy', count(*) FROM pol
        UNION ALL SELECT 'permission_assoc', count(*) FROM assoc""",
    "scan_json_pages": """
        SELECT c.realm, CAST(o.o_custkey AS VARCHAR) AS client_uuid,
               CAST(o.o_orderkey AS VARCHAR) AS policy_id,
               CASE WHEN o.o_orderstatus <> 'P' THEN 'role' ELSE 'user' END AS type,
               count(l.l_orderkey) AS n_refs
        FROM orders o JOIN client c ON c.client_uuid = o.o_custkey
        LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        GROUP BY 1, 2, 3, 4""",
    "scan_policies_by_type": """
        SELECT o_orderkey AS policy_id, o_custkey AS client_uuid FROM orders WHERE o_orderstatus <> 'P'""",
    "scan_clients_pruned": "SELECT client_uuid, client_id FROM client",
    "complete_refs": """
        SELECT CAST(o.o_orderkey AS VARCHAR) AS policy_id, count(l.l_orderkey) AS n_refs
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        WHERE o.o_orderstatus <> 'P' GROUP BY 1""",
    "target_realms": """
        SELECT o_orderkey, concat('NATION_', o_custkey % 25) AS realm, CAST(0 AS INTEGER) AS pos
        FROM orders WHERE o_custkey % 25 <> 0
        UNION ALL
        SELECT o_orderkey, concat('NATION_', length(o_orderpriority)), CAST(1 AS INTEGER)
        FROM orders WHERE length(o_orderpriority) <> o_custkey % 25""",
    "incomplete_exports": """
        SELECT CAST(o_custkey AS VARCHAR) AS realm, 'policy' AS entity, count(*) AS expected,
               count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS actual
        FROM orders GROUP BY 1 HAVING expected <> actual""",
    # Filters
    "filter_reserved": "SELECT realm, client_uuid FROM client WHERE realm <> 'NATION_0'",
    "filter_client_regex": """
        SELECT client_uuid, client_id FROM client WHERE regexp_matches(client_id, '-building$')""",
    "filter_authz_enabled": "SELECT client_uuid FROM client WHERE authz_enabled",
    "split_authz_enabled": """
        SELECT client_uuid, CASE WHEN authz_enabled THEN 'process' ELSE 'skipped' END AS status FROM client""",
    "clean_refs": HOLED,
    "has_refs": f"SELECT policy_id, l_linenumber FROM ({HOLED}) WHERE n_refs > 0",
    "needs_patch": "SELECT client_uuid FROM client WHERE segment <> 'building'",
    "clients_with_findings": "SELECT DISTINCT realm, client_uuid FROM dead",
    # Projections and nested edits
    "flatten_policies": "SELECT realm, client_uuid, policy_id, name FROM pol",
    "decode_role_refs": """
        SELECT CAST(o_orderkey AS VARCHAR) AS policy_id, CAST(l_partkey AS VARCHAR) AS role_id
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "decode_assoc_refs": "SELECT permission_id, CAST(policy_id AS VARCHAR) AS policy_id FROM assoc",
    "explode_refs": """
        SELECT l_orderkey AS policy_id, count(*) OVER (PARTITION BY l_orderkey) AS refs, l_partkey AS role_id
        FROM lineitem""",
    "map_upsert": """
        SELECT event_id, 'k' AS key, props ->> '$.k' AS value FROM events
        UNION ALL SELECT event_id, 'k2', 'true' FROM events""",
    "nested_patch": """
        SELECT l_orderkey, l_linenumber, l_returnflag AS name,
               CASE WHEN l_returnflag IN ('R', 'A') THEN 'true' WHEN l_quantity > 25 THEN 'false' END AS claim
        FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_linestatus,
               CASE WHEN l_linestatus IN ('R', 'A') THEN 'true' WHEN l_quantity > 25 THEN 'false' END
        FROM lineitem""",
    "policy_patch": """
        SELECT o_orderkey AS policy_id, 'logic' AS key, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'fetchRoles', 'false' FROM orders""",
    "insert_missing": """
        SELECT DISTINCT conv_id, 'sub' AS name, 'openid-connect' AS protocol FROM conversations
        WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
    "insert_missing_children": """
        SELECT c_custkey AS client_uuid FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "default_values": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN 'd' ELSE event_type END AS v,
               CASE WHEN event_type = 'click' THEN true END AS clicked
        FROM events""",
    "expand_targets": """
        SELECT c_name AS realm, CASE WHEN t LIKE '-%' THEN concat(c_name, t) ELSE t END AS client_id
        FROM customer, (SELECT unnest(['-login-application', 'sidecar-module-access-client',
                                       'password-reset-client', 'impersonation-client']) AS t)
        WHERE c_name <> 'Customer#000000000'""",
    # Joins
    "ref_liveness": """
        SELECT r.policy_id, r.role_id, x.role_id IS NOT NULL AS alive
        FROM ref r LEFT JOIN role x ON x.realm = r.realm AND x.role_id = r.role_id""",
    "assoc_deadness": """
        SELECT a.permission_id, a.policy_id, d.policy_id IS NOT NULL AS is_dead
        FROM assoc a LEFT JOIN dead d
          ON d.realm = a.realm AND d.client_uuid = a.client_uuid AND d.policy_id = a.policy_id""",
    "pending_clients": "SELECT client_uuid FROM scope WHERE segment <> 'household'",
    "lookup_client": """
        SELECT t.realm, t.client_id, min(m.client_uuid) AS client_uuid
        FROM target t JOIN migration m ON m.realm = t.realm AND m.client_id = t.client_id GROUP BY 1, 2""",
    "missing_targets": """
        SELECT realm, client_id FROM target
        WHERE (realm, client_id) NOT IN (SELECT realm, client_id FROM migration)""",
    "upsert_clients": """
        SELECT coalesce(w.realm, h.realm) AS realm, coalesce(w.client_id, h.client_id) AS client_id,
               CASE WHEN h.realm IS NULL THEN 'create' WHEN w.realm IS NOT NULL THEN 'patch' ELSE 'noop' END AS action,
               h.realm IS NULL OR (w.realm IS NOT NULL AND NOT h.high) AS set_attribute,
               w.realm IS NOT NULL AS add_mapper,
               CASE WHEN h.realm IS NULL THEN 'admin,create-realm' ELSE '' END AS grants,
               CASE WHEN w.realm IS NOT NULL THEN 'true' END AS enabled
        FROM (SELECT realm, label AS client_id FROM client WHERE segment <> 'building'
              UNION ALL SELECT realm, s_name FROM supplier JOIN realm ON nk = s_nationkey) w
        FULL JOIN (SELECT realm, label AS client_id, high FROM migration WHERE balance > 0) h
          ON h.realm = w.realm AND h.client_id = w.client_id""",
    "grant_roles": """
        SELECT s_suppkey, 'create-realm' AS role FROM supplier
        UNION ALL SELECT s_suppkey, 'admin' FROM supplier WHERE s_acctbal <= 0""",
    # Aggregations
    "ref_counts": """
        SELECT r.policy_id, count(*) AS total, count(x.role_id) AS alive
        FROM ref r LEFT JOIN role x ON x.realm = r.realm AND x.role_id = r.role_id GROUP BY 1""",
    "dead_policies": "SELECT * FROM dead",
    "dead_permissions": "SELECT * FROM deadperm",
    "role_count": "SELECT realm, count(DISTINCT role_id) AS n FROM role GROUP BY 1",
    "role_catalogue": "SELECT realm, role_id FROM role",
    "findings_by_client": """
        SELECT s.client_uuid, p.phase, count(f.target_id) AS n
        FROM scope s CROSS JOIN (SELECT unnest(['1', '2-scope', '2-resource']) AS phase) p
        LEFT JOIN finding f ON f.client_uuid = s.client_uuid AND f.phase = p.phase GROUP BY 1, 2""",
    "policies_per_client": """
        SELECT s.client_uuid, count(p.policy_id) AS n
        FROM scope s LEFT JOIN pol p ON p.client_uuid = s.client_uuid GROUP BY 1""",
    "batch_plan": """
        SELECT client_uuid, phase, target_id,
               CAST((row_number() OVER (PARTITION BY realm, client_uuid, phase
                                        ORDER BY left(md5(target_id), 2), target_id) - 1) // 2 AS BIGINT) AS batch_no
        FROM finding""",
    "run_summary": """
        SELECT (SELECT count(*) FROM realm WHERE realm <> 'NATION_0') AS realms_processed,
               (SELECT count(*) FROM scope) AS clients_checked,
               (SELECT count(*) FROM dead) AS dead_policies,
               (SELECT count(*) FROM deadperm) AS dead_permissions,
               ok AS deleted, fail AS delete_failures
        FROM tally""",
    # Sinks
    "delete_plan": "SELECT resource_path, phase, false AS apply FROM plan",
    "patch_plan_body": """
        SELECT client_uuid, 'false' AS enabled, CASE WHEN NOT high AND NOT low THEN label END AS owner,
               CASE WHEN low THEN 'sub' ELSE 'username' END AS first_mapper, 'true' AS first_claim,
               true AS changed
        FROM migration""",
    "page_of_policies": "SELECT policy_id FROM pol ORDER BY policy_id LIMIT 100 OFFSET 100",
    "finding_log": """
        SELECT d.policy_id,
               concat(strftime(p.o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), ' [INFO]   [', p.realm, '/', p.client_id,
                      '] dead role-policy: ', p.name, ' (', d.policy_id, ') refs=', d.refs) AS msg
        FROM dead d JOIN pol p ON p.policy_id = d.policy_id""",
    "outcome_class": """
        SELECT event_id,
               CASE WHEN c IN (204, 404) THEN 'OK' WHEN c IN (401, 503) THEN 'RETRY' ELSE 'FAIL' END AS outcome,
               CASE WHEN c = 204 THEN 'OK' WHEN c IN (401, 503) THEN 'RETRY' ELSE 'FAIL' END AS read_outcome
        FROM code""",
    "outcome_counts": """
        SELECT CASE WHEN c IN (204, 404) THEN 'OK' ELSE 'FAIL' END AS outcome, count(*) AS n FROM code GROUP BY 1""",
    "ledger_append": """
        SELECT CAST(client_uuid AS VARCHAR) AS client_uuid,
               CASE WHEN segment = 'building' THEN 'run-1' ELSE 'run-2' END AS run_id, 'done' AS status
        FROM scope""",
    "replay_dedup": "SELECT resource_path FROM plan",
    # Functions
    "scalar_functions": """
        SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN 2 ELSE 3 END AS BIGINT) AS n_ids,
               event_type IN ('signup', 'purchase') AS matches,
               CAST(props ->> '$.k' AS BIGINT) AS k,
               concat('{"id":', event_id, '}') AS as_text,
               concat(upper(event_type), ',', user_id) AS joined,
               event_type = 'click' AS is_array,
               CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS or_else,
               concat(event_id, chr(9), event_type) AS tsv,
               props ->> '$.k' AS k_text,
               event_type AS trimmed,
               concat('phase=', CASE event_type WHEN 'click' THEN '2-scope' WHEN 'view' THEN '9' ELSE '1' END,
                      ';offset=', user_id) AS cursor,
               CASE WHEN event_type = 'click' THEN '2-scope' ELSE '1' END AS phase,
               CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS position,
               strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
               left(event_type, 2) AS head, right(event_type, 2) AS tail,
               event_type LIKE 'p%' AS starts
        FROM events""",
    # Sessions
    "sticky_flag": """
        SELECT event_id, bool_or(event_type = 'purchase') OVER (
                 PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flag
        FROM events""",
    # Jobs
    "whole_policy_body": """
        SELECT o_orderkey AS policy_id, o_orderpriority AS logic, CAST(o_totalprice AS DOUBLE) AS weight,
               o_orderstatus AS owner, 'true' AS fetch_roles FROM orders""",
    "audit_summary": """
        SELECT (SELECT count(*) FROM realm WHERE realm <> 'NATION_0') AS realms_processed,
               (SELECT count(*) FROM audited) AS clients_checked,
               (SELECT count(*) FROM dead WHERE client_uuid IN (SELECT client_uuid FROM audited)) AS dead_policies,
               (SELECT count(*) FROM deadperm
                WHERE client_uuid IN (SELECT client_uuid FROM audited)) AS dead_permissions,
               count(*) FILTER (CAST(target_id AS BIGINT) % 3 < 2) AS deleted,
               count(*) FILTER (CAST(target_id AS BIGINT) % 3 = 2) AS delete_failures
        FROM (SELECT target_id FROM plan
              WHERE phase = '1' AND client_uuid IN (SELECT client_uuid FROM audited)) AS attempted""",
    "rejected_tenants": """
        SELECT n_name AS realm, 'role' AS entity, count(DISTINCT role_id) + 1 AS expected,
               count(DISTINCT role_id) AS actual, 'incomplete' AS reason
        FROM nation LEFT JOIN role ON realm = n_name WHERE n_regionkey = 2 AND n_name <> 'NATION_0' GROUP BY 1
        UNION ALL
        SELECT n_name, 'policy', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'not announced'
        FROM nation WHERE n_regionkey = 3 AND n_name <> 'NATION_0'""",
    "audit_guarded": """
        SELECT s.realm, s.client_id, f.phase, f.target_id, o.o_orderpriority AS name
        FROM (SELECT client_uuid, '1' AS phase, CAST(policy_id AS VARCHAR) AS target_id, policy_id AS named FROM dead
              UNION ALL
              SELECT d.client_uuid, concat('2-', d.ptype), d.permission_id, min(a.policy_id)
              FROM deadperm d JOIN assoc a ON a.permission_id = d.permission_id GROUP BY 1, 2, 3) f
        JOIN scope s ON s.client_uuid = f.client_uuid AND s.segment = 'building'
        JOIN orders o ON o.o_orderkey = f.named
        WHERE s.realm IN (SELECT n_name FROM nation WHERE n_regionkey NOT IN (2, 3))""",
    "audit_plan": """
        SELECT resource_path, phase, 'delete' AS action, false AS apply,
               CAST((row_number() OVER (PARTITION BY realm, client_uuid, phase
                                        ORDER BY left(md5(target_id), 2), target_id) - 1) // 50 AS BIGINT) AS batch_no
        FROM plan WHERE client_uuid IN (SELECT client_uuid FROM audited)""",
    "token_mode_plan": TOKEN_MODE.format(value="true", changed="NOT high"),
    "token_mode_plan_regular": TOKEN_MODE.format(value="false", changed="true"),
    "token_mode_policies": """
        SELECT o_orderkey AS policy_id, 'true' AS fetch_roles, o_orderstatus AS logic,
               NOT o_totalprice > 250000 AS changed
        FROM orders WHERE o_orderstatus <> 'P'
          AND o_custkey IN (SELECT client_uuid FROM known WHERE authz_enabled)""",
    # Streams
    "stream_policies": """
        SELECT realm, CAST(client_uuid AS VARCHAR) AS client_uuid,
               CAST(policy_id AS VARCHAR) AS policy_id, refs FROM dead""",
    "stream_permissions": """
        SELECT realm, CAST(client_uuid AS VARCHAR) AS client_uuid, permission_id, ptype, refs FROM deadperm""",
    "stream_plan": """
        SELECT resource_path, phase, false AS apply,
               CAST((row_number() OVER (PARTITION BY realm, client_uuid, phase
                                        ORDER BY left(md5(target_id), 2), target_id) - 1) // 50 AS BIGINT) AS batch_no
        FROM plan""",
    "stream_cursors": """
        SELECT c.realm, CAST(c.client_uuid AS VARCHAR) AS client_uuid, '1' AS phase,
               concat('phase=1;offset=', count(*)) AS cursor
        FROM orders o JOIN client c ON c.client_uuid = o.o_custkey
        WHERE o.o_orderstatus <> 'P' AND c.authz_enabled AND c.realm <> 'NATION_0' GROUP BY 1, 2""",
}
for _name in ("stream_late_scope", "stream_counts", "stream_late_details"):
    _SQL[_name] = _SQL["stream_policies"]
_SQL["stream_late_associations"] = _SQL["stream_permissions"]
_SQL["replay_plan"] = _SQL["delete_plan"]
_SQL["page_by_index"] = "SELECT policy_id FROM pol ORDER BY policy_id LIMIT 100 OFFSET 500"
_SQL["ledger_compact"] = """
    SELECT CAST(client_uuid AS VARCHAR) AS client_uuid, 'done' AS status,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'run-4' WHEN c_acctbal > 5000 THEN 'run-3' ELSE 'run-1' END AS run_id
    FROM scope JOIN customer ON c_custkey = client_uuid"""
_SQL["broken_pages"] = """
    SELECT n_name AS realm, 'policy' AS entity, count(*) AS actual, 'unreadable line' AS reason
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE n_regionkey = 2 AND n_name <> 'NATION_0' AND o_orderpriority < '2' GROUP BY 1"""
_SQL["audit_readable"] = """
    SELECT d.realm, CAST(d.client_uuid AS VARCHAR) AS client_uuid, CAST(d.policy_id AS VARCHAR) AS policy_id, d.refs
    FROM dead d JOIN nation ON n_name = d.realm WHERE n_regionkey <> 2"""
_SQL["audit_as_of"] = """
    SELECT r.realm, CAST(r.client_uuid AS VARCHAR) AS client_uuid, CAST(r.policy_id AS VARCHAR) AS policy_id, count(*) AS refs
    FROM ref r JOIN nation ON n_name = r.realm LEFT JOIN dead d ON d.policy_id = r.policy_id
    WHERE n_regionkey <> 2 OR d.policy_id IS NOT NULL GROUP BY 1, 2, 3"""
_SQL["stream_pending"] = """
    SELECT c.realm, CAST(o.o_custkey AS VARCHAR) AS client_uuid, CAST(o.o_orderkey AS VARCHAR) AS policy_id
    FROM orders o JOIN client c ON c.client_uuid = o.o_custkey
    WHERE o.o_orderstatus <> 'P' AND (o.o_orderpriority < '3' OR o.o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"""
_SQL["stream_late_policies"] = _SQL["stream_permissions"]
_SQL["stream_sticky"] = _SQL["sticky_flag"]

ORACLES = {name: BASE + sql for name, sql in _SQL.items()}
