"""What a run leaves behind."""

from confwarden.sinks.ledger import append_ledger, cursors, done_rows, read_ledger, record_run, unseen
from confwarden.sinks.tables import write_batch, write_plan

__all__ = ["append_ledger", "cursors", "done_rows", "read_ledger", "record_run", "unseen", "write_batch", "write_plan"]
