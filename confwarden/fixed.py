"""Fixed values.

Names, formats and defaults that have to equal those of the configuration documents
and of the jobs that read them; results are wrong if any of them is altered.
"""

# Tenants and clients -------------------------------------------------------------
RESERVED_REALM = "master"
CLIENT_PATTERN = "-application$"
CLIENT_TEMPLATES = (
    "-login-application",
    "sidecar-module-access-client",
    "password-reset-client",
    "impersonation-client",
)

# Policy types and audit phases ---------------------------------------------------
ROLE_POLICY = "role"
PERMISSION_TYPES = ("scope", "resource")
POLICY_PHASE = "1"
PERMISSION_PHASES = {"scope": "2-scope", "resource": "2-resource"}
PHASES = ("1", "2-scope", "2-resource")
BATCH_SIZE = 50

# Configuration keys --------------------------------------------------------------
ROLES_KEY = "roles"
ASSOCIATED_KEY = "applyPolicies"
FETCH_ROLES_KEY = "fetchRoles"
TOKEN_MODE_ATTRIBUTE = "client.use.lightweight.access.token.enabled"
CLAIM_KEY = "lightweight.claim"

# Protocol mappers ----------------------------------------------------------------
PATCHED_MAPPERS = ("user_id mapper", "username", "Password reset action mapper")
SUB_MAPPER = {
    "name": "sub",
    "protocol": "openid-connect",
    "protocol_mapper": "oidc-sub-mapper",
    "consent_required": False,
    "config": {
        "lightweight.claim": "true",
        "introspection.token.claim": "true",
        "access.token.claim": "true",
    },
}
REALM_ROLES_MAPPER = {
    "name": "realm roles",
    "protocol": "openid-connect",
    "protocol_mapper": "oidc-usermodel-realm-role-mapper",
    "consent_required": None,
    "config": {
        "claim.name": "realm_access.roles",
        "multivalued": "true",
        "access.token.claim": "true",
        "lightweight.claim": "true",
        "introspection.token.claim": "true",
    },
}

# Service-account clients ---------------------------------------------------------
GRANTED_ROLES = ("admin", "create-realm")
SERVICE_ACCOUNT_PREFIX = "service-account-"
CLIENT_AUTHENTICATOR = "client-secret"

# Formats -------------------------------------------------------------------------
CLIENT_PATH = "/admin/realms/%s/clients/%s"
POLICY_PATH = "/admin/realms/%s/clients/%s/authz/resource-server/policy/%s"
LOG_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
LOG_LINE = "%s [%s] %s"
POLICY_MESSAGE = "  [%s/%s] dead role-policy: %s (%s) refs=%s"
PERMISSION_MESSAGE = "  [%s/%s] dead %s permission: %s (%s)"
CURSOR = "phase=%s;offset=%s"
