"""The jobs users call."""

from confwarden.plans.audit import AuditConfig, AuditResult, Entities, audit, commit_audit
from confwarden.plans.ensure_clients import ensure_clients
from confwarden.plans.stream_audit import StreamAudit, stream_audit
from confwarden.plans.token_mode import TokenModePlan, plan_token_mode

__all__ = [
    "AuditConfig",
    "AuditResult",
    "Entities",
    "StreamAudit",
    "TokenModePlan",
    "audit",
    "commit_audit",
    "ensure_clients",
    "plan_token_mode",
    "stream_audit",
]
