"""Incremental runs.  The streaming checkpoint is the saved position."""

from confwarden.streaming import incremental
from confwarden.streaming.phases import (
    page_stream,
    read_batches,
    stream_dead_permissions,
    stream_dead_policies,
    stream_plan,
)
from confwarden.streaming.sticky import stream_sticky_flag

__all__ = [
    "incremental",
    "page_stream",
    "read_batches",
    "stream_dead_permissions",
    "stream_dead_policies",
    "stream_plan",
    "stream_sticky_flag",
]
